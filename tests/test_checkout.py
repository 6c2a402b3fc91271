"""Reads under a root: what leads out, is missing, too large or no text gives a row with the reason, never text."""

import pytest

from tarnwork.functions import paths
from tarnwork.operators import bundles
from tarnwork.sources import checkout, pysource


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("checkout")
    outside = tmp_path_factory.mktemp("outside")
    (outside / "secret.py").write_text("password = 1")
    (top / "src").mkdir()
    (top / "vendor").mkdir()
    (top / "src" / "a b.py").write_bytes(b"def f():\r\n    return g()\r\rdef g():\n    return 1\n")
    (top / "src" / "caf\u00e9.py").write_text("x = 1\n")
    (top / "src" / "large.py").write_bytes(b"#" * 2_000_001)
    (top / "src" / "most.py").write_bytes(b"#" * 2_000_000)
    (top / "src" / "bad.py").write_bytes(b"x = '\xff'\n")
    (top / "vendor" / "v.py").write_text("y = 1\n")
    (top / "src" / "out.py").symlink_to(outside / "secret.py")
    (top / "out").symlink_to(outside)
    (top / "src" / "in.py").symlink_to(top / "vendor" / "v.py")
    return str(top)


def test_every_uri_gives_a_row(spark, root):
    uris = ["src/a%20b.py", "./src/a b.py", "../outside/secret.py", "src/../../x.py", "/etc/passwd", "C:/x.py", "src/out.py", "out/secret.py", "src/in.py", "src/large.py", "src/most.py", "src/bad.py", "src/gone.py", "src", "src\\caf\u00e9.py", "src/cafe%CC%81.py", "a\0b", ".", "", None, "out/../src/most.py"]
    out = {r.path: r for r in checkout.read(spark.createDataFrame([(u,) for u in uris], "uri string"), root).collect()}
    assert len(out) == len({paths.plain_uri(u) for u in uris if u})
    assert out["src/a b.py"].text == "def f():\n    return g()\n\ndef g():\n    return 1\n"
    assert out["src/caf\u00e9.py"].text == "x = 1\n" and out["src/in.py"].text == "y = 1\n" and len(out["src/most.py"].text) == 2_000_000
    refused = {p for p, r in out.items() if r.refusal}
    # a link is followed before the dots after it
    assert refused == {"../outside/secret.py", "src/../../x.py", "/etc/passwd", "C:/x.py", "src/out.py", "out/secret.py", "a\0b", ".", "out/../src/most.py"}
    assert {p: r.failure for p, r in out.items() if r.failure} == {"src/large.py": checkout.LARGE, "src/bad.py": checkout.NO_TEXT, "src/gone.py": checkout.MISSING, "src": checkout.MISSING}
    assert all((r.text is not None) + (r.refusal is not None) + (r.failure is not None) == 1 for r in out.values())


def test_project_listing(spark, root):
    # a linked folder is listed, and not read
    names = ["out/secret.py", "src/a b.py", "src/bad.py", "src/caf\u00e9.py", "src/in.py", "src/large.py", "src/most.py", "src/out.py"]
    assert [r.path for r in pysource.listing(spark, root).collect()] == names
    assert [r.path for r in pysource.listing(spark, root, 3).collect()] == names[:3]
    out = {r.path: r.text for r in checkout.project(spark, root).collect()}
    assert sorted(out) == names[1:-1] and out["src/large.py"] is None and out["src/bad.py"] is None and out["src/a b.py"].startswith("def f():\n")


def test_bundles_of_a_checkout(spark, root):
    findings = spark.createDataFrame([(1, "src/a%20b.py", 2), (2, "src/out.py", 1), (3, "src/bad.py", 1), (4, "vendor/v.py", 1), (5, "../x.py", 1)], "id int, uri string, line int")
    files = checkout.files_of(spark, root, findings).cache()
    assert {r.path: r.project for r in files.collect()}["vendor/v.py"] is False
    out = {r.id: r for r in bundles.build(findings, files, pysource.symbols(files).cache()).collect()}
    assert out[1].enclosing_function.symbol == "f" and [d.symbol for d in out[1].called_definitions] == ["g"]
    assert [out[k].reasons for k in (2, 3, 4, 5)] == [[bundles.UNRESOLVED, bundles.OUTSIDE], [bundles.UNRESOLVED, bundles.UNREADABLE], [bundles.UNRESOLVED], [bundles.UNRESOLVED, bundles.OUTSIDE]]
    assert out[4].file_class == "VENDORED"
