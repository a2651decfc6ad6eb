import json
import os
import threading
import time
from urllib.error import HTTPError
from urllib.request import urlopen

import pytest

from sidelight.operators.index import HashingEmbedder
from sidelight.plans.service import Service, main, safe_path, serve
from sidelight.schemas import INDEX_DDL


@pytest.fixture(scope="module")
def index(spark):
    e = HashingEmbedder(32)
    rows = [("/p/a.jpg", "a cat on a mat", ["cat"], ["Anna"], None, None, "photos"), ("/p/b.jpg", "a house by the sea", ["sea"], [], None, None, "photos"), ("/p/c.jpg", "a chart", ["chart"], [], None, None, "media")]
    return spark.createDataFrame([(*r, [float(x) for x in e.embed([r[1]])[0]], i) for i, r in enumerate(rows)], INDEX_DDL)


def test_http(spark, index, tmp_path):
    (tmp_path / "x.jpg").write_bytes(b"pixels")
    index.write.parquet(str(tmp_path / "ix"))
    (tmp_path / "dup.json").write_text('{"clusters": []}')
    server = serve(Service(spark, str(tmp_path / "ix"), HashingEmbedder(32), str(tmp_path / "dup.json"), [str(tmp_path)]), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    get = lambda path: urlopen(base + path).read()
    assert b"<form" in get("/")
    assert json.loads(get("/api/stats"))["by_source"] == {"media": 1, "photos": 2}
    found = json.loads(get("/api/search?q=the+sea"))
    assert found["total"] == 2 and found["results"][0]["path"] == "/p/b.jpg"
    assert json.loads(get("/api/search?q=chart&media=1&top=1"))["results"][0]["path"] == "/p/c.jpg"
    assert json.loads(get("/api/search?q=+"))["results"] == []
    assert json.loads(get("/api/duplicates")) == {"clusters": []}
    assert get(f"/thumb?path={tmp_path}/x.jpg") == b"pixels"
    time.sleep(1.1)  # file systems may keep whole seconds
    index.where("seq = 1").selectExpr("'/p/d.jpg' as path", "* except (path)").write.mode("append").parquet(str(tmp_path / "ix"))
    assert json.loads(get("/api/stats"))["total"] == 4
    for bad in ("/thumb?path=/etc/passwd", "/nothing"):
        with pytest.raises(HTTPError):
            get(bad)
    server.shutdown()


def test_without_an_index_and_with_odd_numbers(spark, index, tmp_path):
    for missing in ("none", "none.jsonl"):
        service = Service(spark, str(tmp_path / missing), HashingEmbedder(32))
        assert "error" in service.search("x") and "error" in service.stats() and "error" in service.duplicates()
        with pytest.raises(SystemExit):
            main(["search", str(tmp_path / missing), "x"])
    index.write.parquet(str(tmp_path / "ix"))
    server = serve(Service(spark, str(tmp_path / "ix"), HashingEmbedder(32), None, [str(tmp_path)]), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    assert len(json.loads(urlopen(base + "/api/search?q=sea&top=abc").read())["results"]) == 2
    with pytest.raises(HTTPError) as e:
        urlopen(base + "/thumb?path=none&size=1e3")
    assert e.value.code == 404
    server.shutdown()


def test_safe_path(tmp_path):
    root, other = tmp_path / "root", tmp_path / "root-other"
    for d in (root, other):
        d.mkdir()
        (d / "a.jpg").write_bytes(b"x")
    os.symlink(other / "a.jpg", root / "link.jpg")
    (root / "t.txt").write_text("x")
    roots = [str(root)]
    assert safe_path(str(root / "a.jpg"), roots) == (root / "a.jpg").resolve()
    for bad in (str(other / "a.jpg"), str(root / "link.jpg"), str(root / ".." / "root-other" / "a.jpg"), str(root), str(root / "none.jpg"), str(root / "t.txt"), None, "", "a\0b"):
        assert safe_path(bad, roots) is None


def test_cli(spark, index, tmp_path, capsys):
    index.write.parquet(str(tmp_path / "ix"))
    main(["search", str(tmp_path / "ix"), "anna", "--top", "1"])
    assert capsys.readouterr().out.startswith("1. ")
