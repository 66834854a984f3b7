"""Operators 2 and 6: round trips, broken archives, wrappers."""

from __future__ import annotations

import base64
import hashlib
import struct

import pytest
import zstandard

from chronolock.llm import warc_zstd, wrapper_extract

PAGES = "page_id long, url string, html string, lang string, sha string, refers_to long"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", 5) for i, u, h in rows], PAGES)


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, "http://a/9", "<p>one</p>"), (3, None, None), (4, "http://b c/\n", ""), (5, "u", "é" * 50_000), (6, "u", "only")]
    got = {r.page_id: r for r in warc_zstd.round_trip(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    kept: dict[str, int] = {}
    for i, _, h in rows:
        kept[h or ""] = max(kept.get(h or "", -1), i)
    for i, _, h in rows:
        payload = (h or "").encode()
        assert got[i].payload_bytes == len(payload)
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        last = kept[h or ""]
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == last else ("revisit", last))


def test_ties_null_ids_and_nothing(spark):
    rows = [(7, "u", "same"), (7, "u", "same"), (3, "u", "same"), (None, "u", "same"), (None, "u", "other")]
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in warc_zstd.round_trip(pages(spark, rows)).collect())
    assert got == [(-1, "response", -1), (-1, "revisit", 7), (3, "revisit", 7), (7, "response", -1), (7, "response", -1)]
    assert warc_zstd.round_trip(pages(spark, [])).count() == 0


def archive(records, dictionary=b""):
    trained = zstandard.train_dictionary(1 << 10, [b"%d some text" % (i * 7919) for i in range(400)])
    encode = zstandard.ZstdCompressor(dict_data=trained)
    return warc_zstd.leading_frame(trained.as_bytes()) + b"".join(encode.compress(r) for r in records)


def one(payload=b"hello", digest=None, refers=None):
    digest = digest or base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return warc_zstd.record(1, "http://x/", payload, digest, refers)


def test_reader_accepts_what_the_format_allows():
    raw = archive([one(), one(b"x" * 100_000), one(refers=4)])
    assert [warc_zstd.read_page(x)[2] for x in warc_zstd.read_archive(raw)] == [5, 100_000, 5]
    plain = b"".join(zstandard.ZstdCompressor().compress(one()) for _ in range(2))  # no dictionary
    assert len(list(warc_zstd.read_archive(plain))) == 2
    between = raw + struct.pack("<II", 0x184D2A50, 3) + b"abc"  # a skippable frame at the end
    assert len(list(warc_zstd.read_archive(between))) == 3
    assert list(warc_zstd.read_archive(b"")) == []


@pytest.mark.parametrize("broken", [
    lambda r: r[:-3], lambda r: r + b"junk", lambda r: struct.pack("<II", 0x184D2A5D, 1 << 30) + r[8:], lambda r: r[:8] + b"\0" * 40 + r[48:]])
def test_reader_refuses_broken_archives(broken):
    with pytest.raises((warc_zstd.BadArchive, zstandard.ZstdError)):
        list(warc_zstd.read_archive(broken(archive([one(), one()]))))


@pytest.mark.parametrize("change", [
    (b"WARC/1.1", b"WORC/1.1"), (b"Content-Length: ", b"Content-Length: 9"), (b"WARC-Type: response", b"WARC-Kind: response"), (b"hello", b"jello"), (b"WARC-Date", b" WARC-Date")])
def test_reader_refuses_broken_records(change):
    with pytest.raises(warc_zstd.BadArchive):
        warc_zstd.read_page(one().replace(*change))


def page(body: str, extra: str = "") -> str:
    return f"<!DOCTYPE html><html><head><title>t &amp; u</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li><li><a>News</a></li></ul></nav>{extra}{body}<footer>&copy; 2020</footer></body></html>"


def test_main_text(spark):
    rows = [
        (1, "http://h.example/1", page("<article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n text.<p>Second.</article>", "<div class='ad'>Buy</div>")),
        (2, "http://h.example/2", page("<article><h1>Other</h1><p>A.</p><ul><li>x<li>y</ul><p>B.</p><div class='comments'>no</div></article>")),
        (3, "http://h.example/3", page("<article><h1>Third</h1></article>", "<!-- ad --><aside>side</aside>")),
        (4, "http://h.example/4", None),
        (5, "http://h.example/5", ""),
        (6, None, "<div id=main-text><p>Just &lt;one&gt; block</p></div><div class=sidebar>Side</div>"),
        (7, "http://h.example/7", "plain text & no markup < here"),
        (1, "http://h.example/1", page("<article><p>Again</p></article>")),
    ]
    got = sorted((r.page_id, r.text, r.n_chars) for r in wrapper_extract.main_text(pages(spark, rows)).collect())
    texts = {(i, t) for i, t, _ in got}
    assert (1, "Title & more\nFirst bold text.\nSecond.") in texts and (1, "Again") in texts
    assert (2, "Other\nA.\nx\ny\nB.") in texts and (3, "Third") in texts
    assert (4, "") in texts and (5, "") in texts
    assert (6, "Just <one> block") in texts and (7, "plain text & no markup < here") in texts
    assert all(n == len(t) for _, t, n in got) and len(got) == len(rows)
    assert wrapper_extract.main_text(pages(spark, [])).count() == 0


def test_wrapper_aligns_streams():
    streams = [wrapper_extract.stream(wrapper_extract.parse(h)) for h in ("<p>a</p><p>b</p>", "<h1>t</h1><p>a</p>", "<p>a</p><hr>")]
    whole = streams[0]
    for s in streams[1:]:
        whole = wrapper_extract.merge(whole, s)
    assert wrapper_extract.shape(whole) == "#root(h1?(#) p+(#) hr?)"
    pairs = wrapper_extract.stream(wrapper_extract.parse("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>"))
    assert wrapper_extract.shape(pairs) == "#root(h2+(#) p+(#))"


def test_a_host_without_article_elements_gets_its_largest_container(spark):
    rows = [(i, "http://z.example/", f"<body><div class=top>Menu</div><div class=story><p>{'word ' * 60}{i}</p><p>end {i}</p></div><div class=low>x</div></body>") for i in range(5)]
    got = wrapper_extract.main_text(pages(spark, rows)).collect()
    assert all(r.text == f"{'word ' * 60}{r.page_id}\nend {r.page_id}" for r in got)


def test_the_wrapper_tells_template_from_article(spark):
    """Neither elements nor class names tell; what all pages of a host have alike does."""
    menu = "<div class=ka><div>Start of the site</div><div>All the things that this site has to offer to its many readers every day</div></div>"
    foot = "<div class=kc><p>Written and printed by the people of this site, who thank you for reading it to the very end of the page</p></div>"
    rows = [(i, f"http://w.example/{i}", f"<body>{menu}<div class=kb><p>Text {i} begins.</p><p>{'word%d ' % i * 3}</p></div>{foot}</body>") for i in range(4)]
    got = {r.page_id: r.text for r in wrapper_extract.main_text(pages(spark, rows)).collect()}
    assert got == {i: f"Text {i} begins.\n" + f"word{i} word{i} word{i}" for i in range(4)}
    alone = wrapper_extract.text_of(wrapper_extract.parse(rows[0][2]), [])
    assert "Start of the site" in alone and "thank you" in alone  # without the wrapper the template stays


def test_names_that_only_contain_a_word_stay(spark):
    rows = [(1, "http://n.example/1", "<article><p>a</p><div class='related-work'>b</div><div class='cookie-notice'>c</div><div class='Share Buttons'>d</div></article>")]
    assert wrapper_extract.main_text(pages(spark, rows)).first().text == "a\nb"


def test_deep_and_wide_pages(spark):
    import time

    start = time.time()
    wide = [f"<body><div>{''.join(f'<{t}>x{i}</{t}>' for i, t in enumerate(ts))}</div></body>" for ts in (["p", "h2", "ul", "h3", "pre"] * 10_000, ["h3", "p", "p", "h2", "dl", "ul", "pre"] * 7_000)]
    rows = [(1, "http://d.example/1", "<div>" * 100_000 + "in the deep" + "</div>" * 100_000 + "<p>after</p>"), *((2 + i, "http://e.example/1", h) for i, h in enumerate(wide))]
    got = {r.page_id: r.text for r in wrapper_extract.main_text(pages(spark, rows)).collect()}
    assert got[1] == "in the deep\nafter"
    assert got[2].split("\n") == [f"x{i}" for i in range(50_000)] and len(got[3].split("\n")) == 49_000
    assert time.time() - start < 120


def test_a_task_that_runs_again_leaves_each_record_once(spark, tmp_path):
    """A lost executor's tasks write again, in any order of rows."""
    rows = [(i, f"http://a.example/{i}", f"<p>{i % 40} {'z' * 3000}</p>") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        folder = f"file://{tmp_path}/warc"
        for order in ("page_id", "url"):
            df = pages(spark, rows).repartition(3, order)
            assert warc_zstd.write_archives(df, folder, file_bytes=20_000).agg({"records": "sum"}).first()[0] == 400
        got = sorted(r.page_id for r in warc_zstd.read_archives(spark, folder).collect())
        assert got == list(range(400))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_host_of_one_page_keeps_its_article(spark):
    page = "<html><body><div class='top'>Home Shop About us and contact data of all the shops that we have</div><div class='x'><p>The article.</p><p>Its end.</p></div></body></html>"
    got = spark.createDataFrame([(1, "http://one.example/1", page)], "page_id long, url string, html string")
    assert "The article.\nIts end." in wrapper_extract.main_text(got).first().text


def test_menus_are_apart_at_any_depth(spark):
    deep = "<div>" * 300 + "real<nav><b>MENU</b></nav><aside><p>ADVERT</p></aside> text" + "</div>" * 300
    many = "<span>" * 50_000 + "<p>a</p>" * 5000 + "</i>" * 50_000
    rows = spark.createDataFrame([(1, "http://d.example/1", deep), (2, "http://e.example/1", many)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper_extract.main_text(rows).collect()}
    assert got[1] == "real\ntext" and got[2] == "\n".join(["a"] * 5000)
