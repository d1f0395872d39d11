"""Pages with nested lists, tables, code and images; nested navigation; observation and image files."""

import json

from pyspark.sql import functions as F

from passageworks.operators.enrichment import apply_boundaries
from passageworks.sources import files as FI
from passageworks.sources import pages as PG

PAGE = """<html><head><title>Site</title><style>p {}</style></head><body>
<nav><ul><li><a href="javascript:" p-href="/guide/a.html">Part A</a><ul>
  <li><a href="/guide/b.html?x=1">Page  B</a><ul><li><a href="https://other.org/guide/c.html#f">Page C</a></li></ul></li>
  <li><a href="/guide/d.html">Page D</a></li></ul></li>
  <li><a href="/guide/e.html">Page E</a></li></ul></nav>
<span class="updateInfo">2026-09-20</span>
<article><h1>Sample   page</h1><script>var x = 1;</script>
<h2>Steps</h2><p>First   words
of <b>the</b> <em>text</em>, with <code>kubectl get</code> and <a href="next.html">a link</a>.</p>
<ul><li>one<ul><li>inner <p>para</p></li><li>inner two<ol><li>first</li><li>second</li></ol></li></ul></li><li>two</li></ul>
<ol><li>a</li><li>b</li></ol>
<table><tr><th>Name</th><th>Says</th></tr><tr><td>x|y</td><td><p>line</p><p>other<br>third</p></td></tr></table>
<pre>if a:
    b  =  1
<b>kept</b></pre>
<p>See <img alt="A cat" data-src="img/cat.png" src="blank.gif"> here.</p><button>no</button></article></body></html>"""

BODY = """## Steps

First words of **the** *text*, with `kubectl get` and [a link](https://site.org/guide/next.html).

- one
  - inner para
  - inner two
    1. first
    2. second
- two

1. a
2. b

| Name | Says |
| --- | --- |
| x\\|y | line other third |

```
if a:
    b  =  1
kept
```

See ![A cat](https://site.org/guide/img/cat.png) here."""


def test_an_article_becomes_markdown(spark):
    p = spark.createDataFrame([(1, "http://site.org/guide/a.html?q#f", PAGE.replace("http://site", "https://site")), (2, "https://site.org/x.html", None), (3, "https://site.org/y.html", "<p>no article</p>")],
                              "page_id long, url string, html string").withColumn("url", F.regexp_replace("url", "^http:", "https:"))
    got = {r["page_id"]: r for r in PG.normalize_pages(p).collect()}
    assert "\n".join(line.rstrip() for line in got[1]["body"].split("\n")) == BODY
    assert got[1]["title"] == "Sample page" and got[1]["updated_at"] == "2026-09-20" and got[1]["reason"] is None
    assert got[1]["content"].startswith("# Sample page\n\n来源：https://site.org/guide/a.html\n目录：guide > a.html\n更新时间：2026-09-20\n\n## Steps")
    assert got[2]["reason"] == "NO_ARTICLE" and got[3]["reason"] == "NO_ARTICLE"


def test_nested_navigation(spark):
    p = spark.createDataFrame([(1, "https://site.org/guide/a.html", PAGE)], "page_id long, url string, html string")
    got = [tuple(r)[2:] for r in PG.navigation(p).orderBy("ordinal").collect()]
    assert got == [("a", "Part A", "Part A", "category", "https://site.org/guide/a.html"),
                   ("b", "Page B", "Part A > Page B", "document", "https://site.org/guide/b.html"),
                   ("c", "Page C", "Part A > Page B > Page C", "document", "https://other.org/guide/c.html"),
                   ("d", "Page D", "Part A > Page D", "document", "https://site.org/guide/d.html"),
                   ("e", "Page E", "Page E", "document", "https://site.org/guide/e.html")]


def test_observation_files(spark, tmp_path):
    good = {"evidence_id": "e1", "device_id": "d", "fields": ["a"], "values": [{"field": "a", "value": "1", "unit": "ms", "observed_at": "2024-01-01T00:00:00Z"}]}
    lines = [json.dumps(good), "broken {", "[1]", "17", '{"evidence_id": 5, "values": {}}', "", "   ", json.dumps(good | {"raw_ref": "x" * FI.MAX_RECORD}), '{"evidence_id": "e2"']
    (tmp_path / "obs").mkdir()
    (tmp_path / "obs" / "a.jsonl").write_text("\n".join(lines) + "\n")

    def seen(df):
        rows = df.collect()
        return sorted(r["evidence_id"] for r in rows if r["malformed"] is None), sorted(len(r["malformed"]) for r in rows if r["malformed"] is not None)

    want = ["e1"], sorted(len(x) for x in lines[1:5] + lines[7:])
    table = FI.read_observations(spark, str(tmp_path / "obs"))
    assert seen(table) == want
    assert FI.split_observations(table.where("malformed IS NULL"))[1].collect()[0]["field"] == "a"
    out = []
    q = FI.read_observations(spark, str(tmp_path / "obs"), stream=True).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, n: out.append(seen(d)))
    q.start().awaitTermination()
    assert out == [want]


def test_image_files(spark, tmp_path):
    kinds = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF89a", "webp": b"RIFF1234WEBP"}
    (tmp_path / "img" / "sub").mkdir(parents=True)
    for k, head in kinds.items():
        (tmp_path / "img" / ("sub" if k == "gif" else "") / f"{k}0f.{k}").write_bytes(head + b"rest" * 1000)
    (tmp_path / "img" / "bad1.png").write_bytes(b"<html>")
    (tmp_path / "img" / "bad2.webp").write_bytes(b"RIFF1234WAVE")
    want = {(f"{k}0f", k) for k in kinds} | {("bad1", None), ("bad2", None)}
    table = FI.read_images(spark, str(tmp_path / "img"))
    assert {(r["url_sha"], r["kind"]) for r in table.collect()} == want and table.columns == ["path", "url_sha", "bytes", "kind"]
    out = []
    q = FI.read_images(spark, str(tmp_path / "img"), stream=True).writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, n: out.extend(d.collect()))
    q.start().awaitTermination()
    assert {(r["url_sha"], r["kind"]) for r in out} == want


def test_chunks_are_cut_before_the_block_that_passes_the_limit(spark):
    lines = ["alpha", "", "  beta  ", "gamma", "", "delta 中", "epsilon", "zeta  "]
    blocks = [(1, 1, 1, 1, "s"), (1, 2, 3, 4, "s"), (1, 3, 6, 6, "t"), (1, 4, 7, 7, None), (1, 5, 8, 8, "u")]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    b = spark.createDataFrame(blocks, "doc_id long, block_id long, start_line long, end_line long, section string")
    plan = spark.createDataFrame([(1, 1, 1, 5)], "doc_id long, chunk_no long, start_block long, end_block long")
    body = lambda x, z: "\n".join(lines[x - 1:z]).strip()
    for limit in range(5, 60):
        want, at = [], 0
        for i in range(len(blocks)):
            if i > at and len(body(blocks[at][2], blocks[i][3]).encode()) > limit:
                want.append(body(blocks[at][2], blocks[i - 1][3]))
                at = i
        want.append(body(blocks[at][2], blocks[-1][3]))
        if limit % 6 == 0 or limit < 12:
            got = apply_boundaries(docs, b, plan, limit)[0].orderBy("part").collect()
            assert [r["content"] for r in got] == want, limit


def test_pages_are_parsed_and_sent_in_bounded_batches(monkeypatch):
    import pyarrow as pa

    from passageworks.sources import pages

    monkeypatch.setattr(pages, "PARSED_CHARS", 100)
    html = ["<nav><ul><li><a href='x'>A</a></li></ul></nav><article><h1>t</h1><p>" + "ab " * n + "</p></article>" for n in (50, 1, 1, 60, 0)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["https://a.org/x"] * 6), pa.array(html)], ["page_id", "url", "html"])
    out = list(pages._parse(iter([b, b.slice(0, 0)])))
    assert [x.num_rows for x in out] == [1, 2, 1, 2]
    got = pa.Table.from_batches(out).to_pylist()
    assert [r["page_id"] for r in got] == list(range(6)) and got[3]["body"].split() == ["ab"] * 60 and got[5]["body"] is None and got[5]["nav"] == []
    assert got[0]["nav"] == [{"title": "A", "breadcrumb": ["A"], "href": "x", "kind": "document"}]
