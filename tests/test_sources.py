"""Readers, feed parsers and writers on small files."""

import gzip

import pytest
import json

from pyspark.sql import functions as F

from netloom.schema import FEED_INDEX, UNIFIED
from netloom.sources import feeds, readers, sinks
from netloom.sources.readers import Source


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_line_feeds(spark):
    assert [r.url for r in feeds.http_lines(lines(spark, " http://a.com/x ", "ftp://b", "", "HTTPS://c.com"), "f").collect()] == ["http://a.com/x", "HTTPS://c.com"]
    assert [r.url for r in feeds.url_lines(lines(spark, "# c", "a.com/x", "nodot", " "), "f").collect()] == ["a.com/x"]
    assert [r.domain for r in feeds.domain_lines(lines(spark, "A.com", "#x", "two words", "")).collect()] == ["a.com"]
    crux = lines(spark, "https://m.a.com,1000", "https://m.a.com,500", "http://b.com,900", "https://c.com:8,900", "https://1.2.3.4,900", "bad", "https://d.com,10")
    assert [tuple(r) for r in feeds.ranked_origins(crux, 100, 2000).collect()] == [("m.a.com", 500)]
    cdx = lines(spark, '{"url":"http://a.com","status":"200","mime":"text/html"}', "{bad", '{"url":"http://b.com","status":"404"}', '{"url":"http://c.com"}')
    assert [r.url for r in feeds.capture_index(cdx).collect()] == ["http://a.com", "http://c.com"]
    assert [tuple(r) for r in feeds.ranked_list(lines(spark, "2,B.com", "1,a.com", "x", "3,c.com"), 2).orderBy("rank").collect()] == [(1, "a.com"), (2, "b.com")]
    api = lines(spark, json.dumps([{"url": "http://a.com", "date": "2023-01-01 10:00:00"}, {"url": "http://b.com", "date": None}, {"date": "2023-01-01"}]))
    assert [r.url for r in feeds.api_page(api).collect()] == ["http://a.com"]


def test_csv_feeds(spark, tmp_path):
    (tmp_path / "v.csv").write_text("id,url,submission_time,verified,target\n1,http://a.com,2023-01-01T00:00:00+00:00,yes,Bank\n2,http://b.com,,no,\n")
    assert [(r.url, r.target, r.feed_time.year) for r in feeds.verified_csv(spark, str(tmp_path / "v.csv"), "f").collect()] == [("http://a.com", "Bank", 2023)]
    (tmp_path / "c.csv").write_text('# head\n"1","2023-01-01 10:00:00","http://a.com/x,y","online","","mal","t","l","r"\n"2","short"\n')
    assert [r.url for r in feeds.commented_csv(spark, str(tmp_path / "c.csv"), "f").collect()] == ["http://a.com/x,y"]


def test_json_records(spark, tmp_path):
    rows = [{"kind": "host", "host": "a.com", "dns": {"errors": [], "a": ["1.1.1.1"], "mx_count": 1}}, {"kind": "domain", "domain": "a.com", "rdap": {"status": ["ok"]}}]
    (tmp_path / "r.jsonl").write_text("\n".join([*(json.dumps(r) for r in rows), "{broken"]))
    hosts, domains = feeds.capture_records(spark, str(tmp_path / "r.jsonl"))
    assert hosts.first().dns.a == ["1.1.1.1"] and domains.first().rdap.status == ["ok"]
    rdap = json.dumps({"events": [{"eventAction": "registration", "eventDate": "2020-01-01T00:00:00Z"}], "status": ["active"], "entities": [{"roles": ["registrar"], "handle": "R1"}]})
    r = lines(spark, rdap).select(feeds.rdap_record(F.col("value")).alias("r")).first().r
    assert r.registered.year == 2020 and r.registrar == "R1" and not r.redacted
    boot = lines(spark, json.dumps({"services": [[["com", "NET"], ["https://s/"]]]})).select(feeds.rdap_servers(F.col("value")).alias("s")).first().s
    assert [tuple(x) for x in boot] == [("com", "https://s/"), ("net", "https://s/")]
    cert = json.dumps({"subject": [[["commonName", "a.com"]]], "issuer": [[["organizationName", "CA"]]], "notBefore": "Jan  5 00:00:00 2023 GMT", "subjectAltName": [["DNS", "a.com"], ["IP", "1"]]})
    c = lines(spark, cert).select(feeds.certificate(F.col("value")).alias("c")).first().c
    assert (c.subject_cn, c.issuer_o, c.san_count, c.not_before.day) == ("a.com", "CA", 1, 5)


def test_links_and_short_links(spark):
    page = spark.createDataFrame([("https://www.a.com/x/y", '<a href="/p">1</a><a href="z">2</a><a href="http://b.com/">3</a><a href="mailto:q">4</a><a href="//c.a.com/k#f">5</a>')], "url string, html string")
    assert {r.link for r in feeds.same_site_links(page).collect()} == {"https://www.a.com/p", "https://www.a.com/x/z", "https://c.a.com/k"}
    answers = spark.createDataFrame([("s.co", f"http://s.co/{i}", 301, "http://x.com") for i in range(5)] + [("t.co", "http://t.co/1", 200, None)], "domain string, url string, status int, location string")
    assert {r.domain: r.is_shortener for r in feeds.shortener_verdicts(answers).collect()} == {"s.co": True, "t.co": False}


def test_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("link,type\nhttp://www.a.com/x/y,phishing\n,phishing\nhttp://b.co.uk,legitimate\n")
    src = Source("s", "table", str(tmp_path / "t.csv"), {"url": "link", "label": "type"})
    got = readers.load(spark, src)
    assert [(r.domain, r.label, r.depth) for r in got.orderBy("url").collect()] == [("b.co.uk", 0, 0), ("a.com", 1, 2)]
    assert readers.from_table(readers.read_table(spark, str(tmp_path / "t.csv")), Source("s", "table", columns=src.columns, inverted=True)).where("domain = 'a.com'").first().label == 0
    with gzip.open(tmp_path / "z.jsonl.gz", "wt") as f:
        f.write('{"url": "http://z.com"}\n')
    assert readers.read_table(spark, str(tmp_path / "*.jsonl.gz")).first().url == "http://z.com"
    for name, info, html in (("1_a", "{'url': 'http://a.com/1', 'isotime': '2023-01-01T00:00:00'}", b"<p>caf\xe9</p>"), ("2_b", "http://b.com\nrest", b"<p>b</p>")):
        (tmp_path / "d" / name).mkdir(parents=True)
        (tmp_path / "d" / name / "info.txt").write_text(info)
        (tmp_path / "d" / name / "html.txt").write_bytes(html)
    rows = {r.domain: r for r in readers.load(spark, Source("f", "folders", str(tmp_path / "d"), constant_label=1)).collect()}
    assert rows["a.com"].html == "<p>caf�</p>" and rows["a.com"].date.year == 2023 and rows["b.com"].date is None
    (tmp_path / "e" / "0_x").mkdir(parents=True)
    (tmp_path / "e" / "2023-05-06.txt").write_text("http://a.com\nhttp://b.com\n")
    (tmp_path / "e" / "0_x" / "index.html").write_text("<p>x</p>")
    rows = {r.domain: r for r in readers.load(spark, Source("e", "indexed_list", str(tmp_path / "e"))).collect()}
    assert rows["a.com"].html == "<p>x</p>" and rows["b.com"].html is None and rows["b.com"].date.month == 5
    assert readers.union(spark, [src, Source("n", "empty")]).count() == 2


def test_sources_of_equal_names(spark, tmp_path):
    for group in ("g1", "g2"):
        (tmp_path / "f" / group / "site").mkdir(parents=True)
        (tmp_path / "f" / group / "site" / "info.txt").write_text(f"http://{group}.com")
    (tmp_path / "f" / "g1" / "site" / "html.txt").write_text("<p>one</p>")
    rows = {r.domain: r.html for r in readers.load(spark, Source("f", "folders", str(tmp_path / "f"))).collect()}
    assert rows == {"g1.com": "<p>one</p>", "g2.com": None}
    root = tmp_path / "lists"
    for n, day in ((1, "01_01_2026"), (2, "02_01_2026")):
        (root / f"pages_{n}" / "full" / "0_x").mkdir(parents=True)
        (root / f"pages_{n}" / "full" / "0_x" / "index.html").write_text(f"<p>{n}</p>")
        (root / f"urls_{n}_{day}.txt").write_text(f"http://a{n}.com\r\n\nhttp://b{n}.com\n")
    (root / "pages_2" / "full" / "2_y" / "z").mkdir(parents=True)
    (root / "pages_2" / "full" / "2_y" / "z" / "index.html").write_text("<p>deep</p>")
    rows = {r.domain: (r.html, r.date.day, r.origin) for r in readers.load(spark, Source("l", "indexed_list", str(root))).collect()}
    assert rows == {"a1.com": ("<p>1</p>", 1, "l_1"), "b1.com": (None, 1, "l_1"), "a2.com": ("<p>2</p>", 2, "l_2"), "b2.com": ("<p>deep</p>", 2, "l_2")}


def test_damaged_pointer(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "n int")
    sinks.save_version(df, str(tmp_path / "v"), 1)
    assert sinks.load_version(spark, str(tmp_path / "v"), "n int").count() == 1
    for f in (tmp_path / "v" / "_versions").glob("part-*"):
        f.write_text("{oops")
    for f in (tmp_path / "v" / "_versions").glob(".*.crc"):
        f.unlink()
    with pytest.raises(ValueError):
        sinks.load_version(spark, str(tmp_path / "v"), "n int")


def test_scratch_is_deleted(spark):
    import os

    from netloom.plans import materialise as m

    with m.scratch(spark):
        m.materialise(spark.range(3), "scratch")
        path = m._WRITTEN[-1].removeprefix("file://")
        assert os.path.isdir(path)
    assert not os.path.isdir(path)


def test_interim_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("http://a.com", "a.com", 1, None, "s", "<p>" + "word " * 60 + "</p>", 0, "", "a.com"), ("http://b.com", "b.com", 0, None, "s", None, 0, "", "b.com"), ("x", "", 0, None, "s", None, 0, "", "")], UNIFIED)
    it = readers.interim(df)
    rows = sorted(it.collect(), key=lambda r: r.row_id)
    assert [r.row_id for r in rows] == [1, 2] and {r.has_html: r.html_simhash is None for r in rows} == {True: False, False: True}
    sinks.write_interim(it, str(tmp_path / "i"))
    assert sinks.complete(spark, str(tmp_path / "i")) and not sinks.complete(spark, str(tmp_path / "nothing"))
    assert sinks.load_version(spark, str(tmp_path / "x"), FEED_INDEX).count() == 0
    sinks.write_table_csv(spark.createDataFrame([(2,), (1,)], "n int"), str(tmp_path / "c"), ["n"])
    assert [r.n for r in spark.read.options(header="true").csv(str(tmp_path / "c")).collect()] == ["1", "2"]
    sample = spark.createDataFrame([("p",), ("q",)], "page_id string")
    status = spark.createDataFrame([("p", "failed", 1), ("p", "ok", 2)], "page_id string, status string, at int")
    assert {r.page_id: r.status for r in sinks.render_index(sample, status).collect()} == {"p": "ok", "q": "pending"}
    assert [r.page_id for r in sinks.todo(sample, status).collect()] == ["q"]


def test_public_suffixes_from_a_file(spark, tmp_path):
    from netloom.operators import suffixes

    (tmp_path / "list.dat").write_text("// public\ncom\nuk\nco.uk\ngov.in // note\nin\ncom.pl\npl\nck\n*.ck\n!www.ck\n\n// ===BEGIN PRIVATE DOMAINS===\ngithub.io\nweb.app\n")
    rules = suffixes.read_suffixes(spark, str(tmp_path / "list.dat"))
    assert rules.count() == 12 and rules.where("private").count() == 2
    want = {"login.secure.paypal.co.uk": "paypal.co.uk", "a.gov.in": "a.gov.in", "b.a.gov.in": "a.gov.in", "x.com.pl": "x.com.pl", "a.b.foo.ck": "b.foo.ck", "a.www.ck": "www.ck", "1.2.3.4": "1.2.3.4", "a.web.app": "web.app", "co.uk": "co.uk", "localhost": "localhost", "x.y.unknown": "y.unknown"}
    df = spark.createDataFrame([(h,) for h in [*want, None, ""]], "host string").withColumn("size", F.lit(9))
    assert {r.host: r.domain for r in suffixes.registrable(df, rules).collect()} == want
    own = {r.host: r.domain for r in suffixes.registrable(df, rules, private=True).collect()}
    assert own["a.web.app"] == "a.web.app"
