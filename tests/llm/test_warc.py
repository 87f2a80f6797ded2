import base64
import gzip
import hashlib
import io
import random
import zlib

import pytest

from lodestone.llm import warc as W


def packed(records, gz=True):
    out = b""
    for rid, body in records:
        raw = W.record_head(rid, f"http://x/{rid}", len(body), W._sha1(hashlib.sha1(body))) + body + b"\r\n\r\n"
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += z.compress(raw) + z.flush() if gz else raw
    return out


BODIES = [("a", b""), ("b", b"short"), ("c", bytes(range(256)) * 3000), ("d", b"\r\n\r\nWARC/1.1\r\n" * 50), ("e", b"x" * W.CHUNK_BYTES), ("f", b"y" * (W.CHUNK_BYTES + 1))]


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("chunk", [W.CHUNK_BYTES, 1000])
def test_chunks_join_again(gz, chunk):
    data = packed(BODIES, gz)
    rows = list(W.records(io.BytesIO(data), "f", chunk))
    for rid, body in BODIES:
        mine = [r for r in rows if r["record_id"] == rid]
        assert b"".join(r["chunk"] for r in mine) == body and [r["chunk_no"] for r in mine] == list(range(len(mine)))
        assert all(r["n_bytes"] <= chunk for r in mine) and [r["is_last"] for r in mine] == [False] * (len(mine) - 1) + [True]
        for r in mine:
            assert r["sha1_so_far"] == W._sha1(hashlib.sha1(body[: r["start"] + r["n_bytes"]]))
        assert mine[-1]["verified"] is True and mine[0]["headers"] and all(r["headers"] is None for r in mine[1:])
    starts = {r["record_id"]: r["offset"] for r in rows}
    assert starts["a"] == 0 and all(data[o : o + 2] == (b"\x1f\x8b" if gz else b"WA") for o in starts.values())


class Watched(io.BytesIO):
    most = 0

    def read(self, n=-1):
        Watched.most = max(Watched.most, n if n >= 0 else 1 << 60)
        return super().read(n)


def test_no_record_is_held_whole():
    rows = W.records(Watched(packed([("big", b"z" * 50_000_000)])), "f", 10_000)
    assert max(r["n_bytes"] for r in rows) == 10_000 and Watched.most <= 10_000


@pytest.mark.parametrize("cut", [1, 30, 300, 900])
def test_cut_files(cut):
    data = packed(BODIES[1:3])
    with pytest.raises(ValueError, match="record at"):
        list(W.records(io.BytesIO(data[:-cut] if cut < 900 else data[:100]), "f"))
    last = list(W.records(io.BytesIO(data[:-cut]), "f", on_error="mark"))[-1]
    assert last["error"]


def test_wrong_digest():
    raw = W.record_head("r", None, 3, "sha1:AAAA") + b"abc\r\n\r\n"
    (row,) = W.records(io.BytesIO(raw), "f")
    assert row["verified"] is False and row["target_uri"] is None


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>é</p>", "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "big" * 60_000, "x"), (4, "two\nlines", "t", "x"), (4, "u", "t", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, chunk string").repartition(3)
    got = W.round_trip(df, 1000).collect()
    bodies = {}
    for r in sorted(got, key=lambda r: r["chunk_no"]):
        bodies.setdefault(r["record_id"], []).append(bytes(r["chunk"]))
    assert len({(r["record_id"], r["chunk_no"]) for r in got}) == len(got)
    assert sorted(b"".join(v).decode() for v in bodies.values()) == sorted(r[2] or "" for r in rows)
    assert sum(r["is_last"] for r in got) == len(rows) and all(r["verified"] for r in got if r["is_last"])
    assert W.round_trip(df.limit(0)).count() == 0
    W.write_warc(df, str(tmp_path / "w")).collect()
    assert W.read_warc(spark, str(tmp_path / "w")).where("is_last").count() == len(rows)


def b32(method, data):
    return method + ":" + base64.b32encode(hashlib.new(method, data).digest()).decode()


def record(kind, content, block, **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}-{len(block)}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": content, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Long: " + b"h" * 3000 + b"\r\n\r\n"
PAYLOAD = b"<html>" + b"payload \r\n\r\n" * 500 + b"</html>"
CRAWL = [
    (record("warcinfo", "application/warc-fields", b"software: x\r\n"), None),
    (record("request", "application/http; msgtype=request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", WARC_Payload_Digest=b32("sha1", b"")), True),
    (record("response", "application/http; msgtype=response", HTTP + PAYLOAD, WARC_Payload_Digest=b32("sha1", PAYLOAD), WARC_Block_Digest=b32("sha1", HTTP + PAYLOAD)), True),
    (record("response", "application/http;msgtype=response", HTTP + PAYLOAD + b"1", WARC_Payload_Digest="sha256:" + hashlib.sha256(PAYLOAD + b"1").hexdigest()), True),
    (record("response", "application/http; msgtype=response", HTTP + PAYLOAD + b"22", WARC_Payload_Digest=b32("sha1", HTTP + PAYLOAD + b"22")), False),
    (record("response", "application/http; msgtype=response", HTTP + PAYLOAD + b"333", WARC_Payload_Digest=b32("sha1", PAYLOAD + b"333"), WARC_Block_Digest=b32("sha1", b"other")), False),
    (record("revisit", "application/http; msgtype=response", HTTP, WARC_Payload_Digest=b32("sha1", PAYLOAD), WARC_Block_Digest=b32("sha1", HTTP)), True),
    (record("resource", "image/png", b"\x89PNG" * 99, WARC_Payload_Digest=b32("md5", b"\x89PNG" * 99)), True),
    (record("conversion", "text/plain", b"text", WARC_Payload_Digest="crc32:1234"), None),
]


@pytest.mark.parametrize("chunk", [7, 1000, W.CHUNK_BYTES])
def test_records_of_a_crawl(chunk):
    rows = [r for r in W.records(io.BytesIO(b"".join(gzip.compress(r) for r, _ in CRAWL)), "f", chunk) if r["is_last"]]
    assert [r["verified"] for r in rows] == [v for _, v in CRAWL]


def slow_reader(data):
    """All records of a file at once, by lengths alone."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        n = int(head["Content-Length"])
        out.append((head["WARC-Record-ID"].strip("<>"), head, data[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
    return out


@pytest.mark.parametrize("seed", range(6))
def test_reader_against_brute_force(seed):
    rng = random.Random(seed)
    blocks = [rng.randbytes(rng.choice([0, 1, 5, 999, 1000, 1001, 5000])) for _ in range(12)]
    data = b"".join((gzip.compress if seed % 2 else bytes)(record("resource", "x", b, WARC_Place=str(k), WARC_Block_Digest=b32("sha1", b))) for k, b in enumerate(blocks))
    got, heads = [], []
    for r in W.records(io.BytesIO(data), "f", 1000):
        if r["chunk_no"] == 0:
            got.append((r["record_id"], b""))
            heads.append({k.lower(): v for k, v in r["headers"]})
        got[-1] = (got[-1][0], got[-1][1] + r["chunk"])
    true = slow_reader(data)
    assert got == [(i, b) for i, _, b in true] and heads == [{k.lower(): v for k, v in h.items()} for _, h, _ in true]


def test_files_are_written_as_told(spark, tmp_path):
    """Every byte of every payload, by a reader of another make."""
    rows = [(k // 2, f"http://h/{k}", "p" * (k * 37_000)) for k in range(8)]
    W.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), str(tmp_path / "w")).collect()
    found = [x for f in sorted((tmp_path / "w").glob("*.warc.gz")) for x in slow_reader(f.read_bytes())]
    assert sorted((h["WARC-Target-URI"], b.decode()) for _, h, b in found) == sorted((u, t) for _, u, t in rows)
    assert len({i for i, _, _ in found}) == len(rows)
