"""Licences, html, contamination, mixing, WARC, tokens and GIF."""

import gzip
import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontam, gif, html, licenses, mixing, queries, tokens, warc


def test_licenses(spark, docs):
    mit = next(t for i, t in licenses.known_texts() if i == "MIT")
    rows = docs(
        [
            (1, "MIT Licence\n\nCopyright (c) 2020 Some One\nAll rights reserved.\n" + mit[len("MIT License") :].upper().replace(",", ";"), None, None),
            (2, "some words\r\nReleased under the MIT license", None, None),
            (3, None, None, None), (4, "...\n!!", None, None), (None, "Licensed under CC BY-NC 4.0.\nlicensed under cc by nc 4.0", None, None), (2, "other", None, None), (6, "word " * 200_000, None, None),
        ]
    )
    got = sorted((str(r["doc_id"]), r["license_id"], r["notices"], r["n_notices"]) for r in licenses.scan_licenses(rows).collect())
    assert got == [("1", "MIT", "", 0), ("2", None, "", 0), ("2", None, "MIT", 1), ("3", None, "", 0), ("4", None, "", 0), ("6", None, "", 0), ("None", None, "CC-BY-NC-4.0", 2)]
    assert licenses.scan_licenses(rows.limit(0)).count() == 0


def text_of(source):
    page = html.Page(source)
    gone = page.furniture()
    return page.text(gone, page.main(gone))


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("<p>a &amp; b&nbsp;c<p>d<br>e", "a & b c d e"),
        ("<body><header>Site</header><nav>x</nav><article><header><h1>T</h1></header><p>Hi <b>x</b>y</p><aside>s</aside><form>f</form></article><footer>z</footer>", "T Hi xy"),
        ("<article>t<script>var x = '</p>';</script><style>p{}</style><!-- c --><div class='comments'>c</div><div id=cookie-notice>n</div></article>", "t"),
        ("<main><p>m</p><article class='comment'>c</article></main>", "m"),
        ("<div class='page-header'>h</div><div class='sidebar'>s</div><div class='content'><p>c1</p><ul><li>a<li>b</ul></div>", "c1 a b"),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<article><p title='a > b'>x</p><p hidden>y</p><p style='display: none'>z</p></article>", "x"),
        ("a < b and <3 <article", "a < b and <3"),
        ("<article><table><tr><td>1<td>2<tr><td>3</table></article>", "1 2 3"),
    ],
)
def test_main_text(source, text):
    assert text_of(source) == text


def test_deep_pages():
    assert text_of("<div>" * 5000 + "x") == "x"
    assert text_of("<p>" + "y" * 1_000_000) == "y" * 1_000_000


def test_site_templates(spark):
    box = "<div><p>Join 5000 readers of this site</p></div>"
    pages = [(i, f"http://h.example/{i}", f"<title>t{i}</title><body>{box}<p>text number {i}</p></body>") for i in range(8)]
    pages += [(100 + i, "http://copies.example/x", f"<title>same</title><body>{box}<p>all alike</p></body>") for i in range(8)]
    pages += [(200, None, None), (201, "odd", ""), (202, "http://h.example/q", f"<title>q</title><article>{box}<p>text number 1</p></article>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html.extract_main_text(df).collect()}
    assert len(got) == 19 and got[3]["text"] == "text number 3" and got[3]["n_chars"] == 13
    assert got[101]["text"] == "Join 5000 readers of this site all alike"  # copies of one page are no template
    assert got[202]["text"] == "text number 1" and got[200]["text"] == got[201]["text"] == ""
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_contamination(spark, docs):
    item = "If John buys 12 kg of apples in Paris and gives half of the apples to his friend Mary, how many apples are left for him at the end"
    other = "If Peter buys 40 kg of apples in Rome and gives half of the apples to his friend Anna, how many apples are left for him at the end"
    mixed = "If Peter buys 40 kg of apples in Rome and gives half of the apples to his friend Peter and then 7 more days pass until the very end"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "red green blue")], "item_id long, text string")
    filler = "quiet rivers run under old stone bridges while children watch the boats go by in summer "
    rows = docs([(1, filler + item + " " + filler, None, None), (2, filler + other, None, None), (3, filler * 5, None, None), (4, None, None, None), (5, "", None, None), (6, "say red, green; BLUE now", None, None), (None, item, None, None), (8, filler * 9000 + item, None, None), (9, mixed.replace("apples", "pears"), None, None)])
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontam.contaminated(rows, bench).collect()}
    assert got == {(1, 1): "exact", (2, 1): "reparameterised", (6, 4): "exact", (None, 1): "exact", (8, 1): "exact"}
    kept = decontam.drop_contaminated(rows, bench)
    assert kept.columns == rows.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 9]
    assert decontam.contaminated(rows.limit(0), bench).count() == 0 and decontam.contaminated(rows, bench.limit(0)).count() == 0


def test_slots_must_agree(spark):
    item = "Ask Anna to bring 5 cups and let Anna wash the 5 cups before she puts them all away again"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    same = item.replace("5", "9").replace("Anna", "Maria")
    apart = item.replace("bring 5", "bring 9").replace("let Anna", "let Maria")
    got = {r["doc_id"] for r in decontam.contaminated(spark.createDataFrame([(1, same), (2, apart)], "doc_id long, text string"), bench).collect()}
    assert got == {1}


def test_canonical_pieces():
    reader = decontam.Canonical()
    keep = decontam.CHUNK
    text = "one more thing about 3.5 km and 1,000 Words. " * 50
    a = reader.tokens(text)
    decontam.CHUNK = 100
    b = reader.tokens(text)
    decontam.CHUNK = keep
    assert (a[0] == b[0]).all() and len(a[0]) == len(b[0])
    assert [int(k) for k in reader.tokens("He has 3.5 km and 7 dogs")[1]] == [0, 0, 1, 3, 0, 1, 0]


def test_mix(spark, docs):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), None, [None, "a", "b", "B", "c"][rng.integers(5)]) for i in range(300)] + [(500, None, None, "a"), (501, "x " * 50_000, None, "tiny"), (None, "q r", None, "a"), (7, "again", None, "b")]
    out = mixing.plan_mix(docs(rows)).collect()
    assert len(out) == len(rows)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    targets = {s: v[0]["target"] for s, v in by.items()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free = [s for s in by if targets[s] < 2 * sum(r["size"] for r in by[s]) - 1e-9]
    levels = {round(targets[s] / weight[s], 6) for s in free}
    assert len(levels) <= 1
    for s, v in by.items():
        assert abs(sum(r["taken"] for r in v) - targets[s]) < 1 and all(r["source_size"] == sum(x["size"] for x in v) for r in v)
    assert sorted(map(str, mixing.plan_mix(docs(rows[::-1])).collect())) == sorted(map(str, out))
    positions = [r["position"] for r in mixing.training_order(mixing.plan_mix(docs(rows))).collect()]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert mixing.plan_mix(docs(rows[:1]).limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.plan_mix(docs([(1, None, None, "a"), (2, "", None, "b")])).collect())


def test_schedule_is_the_inverse_of_its_integral(spark):
    rows = spark.createDataFrame([(d / 10, a, b) for d in range(11) for a, b in ((1.0, 3.0), (3.0, 1.0), (1.0, 1.0))], "due double, a double, b double")
    for r in rows.select("*", mixing._position(F.col("due"), F.col("a"), F.col("b")).alias("t")).collect():
        share = (r["a"] * r["t"] + (r["b"] - r["a"]) * r["t"] ** 2 / 2) / ((r["a"] + r["b"]) / 2)
        assert abs(share - r["due"]) < 1e-9


def test_warc_round_trip(spark, tmp_path):
    same = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 20
    pages = [(5, "http://a/1", same), (3, "http://a/2 x", same), (9, None, same), (4, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (None, "n", same), (3, "again", same), (11, "z", "y" * 3_000_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.archive_round_trip(df, str(tmp_path / "w"), keep_payload=True).collect()
    assert len(got) == len(pages)
    for r in got:
        x = r["response"]
        want = {p: (h or "").encode() for p, _, h in pages}[r["page_id"]]
        assert (x["payload_bytes"], x["payload_digest"]) == (len(want), hashlib.sha256(want).hexdigest())
        assert r["request"]["http_header"].startswith("GET ") and (x["type"] == "revisit" or bytes(x["payload"]) == want)
    kinds = sorted((str(r["page_id"]), r["response"]["type"], r["refers_page"]) for r in got)
    assert kinds == sorted([("3", "response", None)] * 2 + [("5", "revisit", 3), ("9", "revisit", 3), ("None", "response", None)] + [(i, "response", None) for i in ("4", "6", "7", "8", "11")])
    assert warc.archive_round_trip(df.limit(0), str(tmp_path / "e")).count() == 0


def test_warc_parser():
    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nx\r\n\r\n\r\n"
    assert [r[1] for r in warc.parse_records(one * 3)] == ["metadata"] * 3
    assert len(list(warc.parse_records(gzip.compress(one) + gzip.compress(one)))) == 2  # a member a record
    assert len(list(warc.parse_records(one + one[:-8]))) == 1 and list(warc.parse_records(b"")) == [] and list(warc.parse_records(b"junk")) == []
    damage = []
    assert len(list(warc.parse_records(gzip.compress(one * 5)[:-9], damage))) >= 0 and damage
    damage = []
    assert len(list(warc.parse_records(one * 2, damage))) == 2 and damage == [] and len(list(warc.parse_records(one + b"junk" * 9, damage))) == 1 and damage == ["no record header"]


def test_token_histogram(spark, docs):
    if not os.path.exists(tokens.VOCABULARY):
        pytest.skip("no vocabulary here")
    import tiktoken  # noqa: F401

    texts = ["hello world", "a", None, "", "hello world", "the quick brown fox " * 400, "x" * 50_000] + [f"word{i} " * (i % 9) for i in range(60)]
    encoder = tokens._encoder(tokens.load_ranks(spark))
    lengths = sorted(len(encoder.encode_ordinary(t)) if t else 0 for t in texts)
    h = tokens.token_histogram(docs([(i, t, None, None) for i, t in enumerate(texts)]))
    got = {r["n_tokens"]: r for r in h.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert (r["docs"], r["docs_over"], r["tokens_over"]) == (lengths.count(n), sum(x > n for x in lengths), sum(x for x in lengths if x > n))
        assert r["truncated_total"] == sum(min(x, n) for x in lengths) and (r["rank_from"], r["rank_to"]) == (sum(x < n for x in lengths) + 1, sum(x <= n for x in lengths))
    for r in tokens.context_limits(h, [0, 5, 10**6]).collect():
        assert (r["total"], r["truncated_total"]) == (sum(lengths), sum(min(x, r["limit"]) for x in lengths))
    assert {r["share"]: r["n_tokens"] for r in tokens.quantile_lengths(h, [0.0, 0.5, 1.0]).collect()} == {0.0: lengths[0], 0.5: lengths[-(-len(lengths) // 2) - 1], 1.0: lengths[-1]}
    assert tokens.token_histogram(docs([(1, "a", None, None)]).limit(0)).count() == 0


def naive_lzw(stream, bits):
    """A decoder as the format's description has it, a code at a time."""
    clear, end = 1 << bits, (1 << bits) + 1
    acc = n = 0
    out, table, size, prev = b"", {}, bits + 1, None
    for byte in stream:
        acc |= byte << n
        n += 8
        while n >= size:
            code, acc, n = acc & ((1 << size) - 1), acc >> size, n - size
            if code == clear:
                table, size, prev = {i: bytes([i]) for i in range(clear)} | {clear: b"", end: b""}, bits + 1, None
                continue
            if code == end:
                return out
            entry = table[code] if code in table else prev + prev[:1]
            out += entry
            if prev is not None and len(table) < 4096:
                table[len(table)] = prev + entry[:1]
                if len(table) == 1 << size and size < 12:
                    size += 1
            prev = entry
    return out


def test_lzw():
    rng = random.Random(1)
    for k in range(40):
        n = rng.choice([0, 1, 2, 300, 9000, 70_000])
        data = bytes(rng.randrange(256) for _ in range(n)) if k % 3 == 0 else bytes([rng.randrange(3)]) * n if k % 3 == 1 else (b"the cat sat on the mat " * n)[:n]
        for compress in (True, False):
            stream = gif.lzw_encode(data, compress=compress)
            assert gif.lzw_decode(stream, 8, len(data)) == data
            if n <= 9000:
                assert naive_lzw(stream, 8) == data
    with pytest.raises(gif.GifError):
        gif.lzw_decode(b"\xff\xff\xff", 2, 100)


def test_gif_frames():
    """Palettes, interlacing, transparency and disposal, drawn by hand."""
    red, blue = np.array([[9, 9, 9], [255, 0, 0], [0, 0, 255], [0, 255, 0]], np.uint8), None
    del blue

    def image(left, top, w, h, rows, flags=0, local=b""):
        s = gif.lzw_encode(bytes(x for r in rows for x in r), 2)
        return b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + local + b"\x02" + bytes([len(s)]) + s + b"\0"

    def control(disposal, delay, transparent=None):
        return b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"

    data = b"GIF89a" + struct.pack("<HHBBB", 2, 8, 0xF1, 0, 0) + red.tobytes()
    data += control(1, 5) + image(0, 0, 2, 8, [[1, 1]] * 8)
    data += control(2, 7, 0) + image(0, 0, 2, 1, [[0, 2]])
    data += control(3, 2) + image(0, 4, 1, 1, [[0]], 0x81, np.array([[7, 8, 9]] * 4, np.uint8).tobytes())
    data += image(0, 0, 2, 8, [[k % 4] * 2 for k in range(8)], 0x40) + b"\x3b"
    f = list(gif.read_gif(data))
    assert [x.at_ms for x in f] == [0, 50, 120, 140] and [x.delay_ms for x in f] == [50, 70, 20, 0]
    assert f[0].canvas[3, 1].tolist() == [255, 0, 0, 255]
    assert f[1].canvas[0].tolist() == [[255, 0, 0, 255], [0, 0, 255, 255]]  # transparent index keeps what is below
    assert f[2].canvas[0].tolist() == [[0, 0, 0, 0]] * 2 and f[2].canvas[4, 0].tolist() == [7, 8, 9, 255]
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    assert [f[3].canvas[order[k], 0, :3].tolist() for k in range(8)] == [red[k % 4].tolist() for k in range(8)]
    assert gif.histogram(f[0].canvas)[0b110000] == 16
    with pytest.raises(gif.GifError):
        list(gif.read_gif(data[:60]))
    with pytest.raises(gif.GifError):
        list(gif.read_gif(b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b"))


def test_media_round_trip(spark, docs, tmp_path):
    rows = [(1, "hello é", None, None), (2, None, None, None), (3, "", None, None), (4, "y" * 192, None, None), (None, "long " * 60_000, None, None), (1, "hello é", None, None)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_media_gif(spark, str(tmp_path)).collect()
    assert len(got) == 6
    want = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        p = b.ljust(max(1, -(-len(b) // 192)) * 192)
        want[i] = (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert all((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == want[r["doc_id"]] for r in got)
    assert all(sum(map(int, r["feature"].split(","))) == r["payload_bytes"] for r in got)
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"no gif"))], "id int, media binary")
    read = {r["id"]: r for r in gif.read_media(odd).collect()}
    assert read[1]["error"] is None and read[1]["frames"] is None and read[2]["error"] == "no GIF header"
    assert gif.frame_rows(gif.read_media(gif.store_texts(docs(rows)))).where("doc_id is null").count() == 4


def test_archives_as_streams(spark, tmp_path, monkeypatch):
    """Payloads full of record ends, archives of several members, cut-off and plain ones, all in one folder; few large archives or many small."""
    import gzip

    from tidemark.llm import warc

    pages = [(i, f"http://h/{i}", ("\r\n\r\nWARC/1.1\r\n\r\n" * 30 + f"é{i}") if i % 3 else "") for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for small in (1 << 12, 1 << 24):
        monkeypatch.setattr(warc, "SMALL_BYTES", small)
        path = str(tmp_path / f"a{small}")
        warc.write_archives(warc.plan_records(df), path)
        got = warc.read_archives(spark, path).where("type = 'response'").collect()
        assert sorted(bytes(r["payload"]).decode() for r in got) == sorted(p[2] for p in pages)
        assert len(list((tmp_path / f"a{small}").glob("*.gz"))) == (1 if small > 1 << 20 else 9)
    record = lambda i, body: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "many.warc.gz").write_bytes(gzip.compress(record(1, "a\r\n\r\nb")) + gzip.compress(record(2, "c")))
    (folder / "cut.warc.gz").write_bytes(gzip.compress(record(3, "d") + record(4, "e" * 5000)[:200]))
    (folder / "plain.warc").write_bytes(record(5, "\r\n\r\n") + record(6, "x"))
    got = {r["record_id"]: bytes(r["payload"]) for r in warc.read_archives(spark, str(folder)).collect()}
    assert got == {"<1>": b"a\r\n\r\nb", "<2>": b"c", "<3>": b"d", "<5>": b"\r\n\r\n", "<6>": b"x"}
    assert [(r["records"], r["damage"]) for r in warc.damaged_archives(spark, str(folder)).collect()] == [(1, "record cut off")]
