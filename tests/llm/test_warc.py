import gzip
import hashlib
import os

from pyspark.sql import functions as F

from tempora.llm import warc as A


def pages():
    long = "<p>" + "é" * 200
    rows = [(3, "http://a", long), (1, "http://b", long), (2, None, "short"), (5, "http://c\r\nX: y", "short"), (4, "u", None),
            (6, "v", ""), (7, "w", "x" * 300_000), (None, "n", long), (8, "q", "a\r\n\r\nb" * 50), (9, "q", long)]
    return rows


def expected(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None and len(b) >= 100:
            first[b] = min(first.get(b, i), i)
    out = {}
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and first.get(b, i) != i
        out[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None)
    return out


def test_round_trip(spark, tmp_path):
    rows = pages()
    d = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = f"file://{tmp_path}/out"
    A.archive(d, path)
    got = {}
    for r in A.read(spark, path).withColumns({"id": A.key_of("record_id"), "to": A.key_of("refers_to")}).collect():
        i = None if r.id == "null" else int(r.id)
        again = r.record_type == "revisit"
        body = bytes(r.payload)
        assert again == (r.refers_to is not None)
        if not again:
            assert r.payload_digest == "sha256:" + hashlib.sha256(body).hexdigest() and len(body) == r.payload_length
        got[i] = (r.payload_length, r.payload_digest[7:], r.record_type, int(r.to) if again else None)
    assert got == expected(rows)
    uris = {r.target_uri for r in A.read(spark, path, "none").collect()}
    assert None in uris and "http://c%0D%0AX: y" in uris


def test_predicates_are_pushed_and_payloads_skipped(spark, tmp_path):
    d = spark.createDataFrame(pages(), "page_id long, url string, html string")
    path = f"file://{tmp_path}/out"
    A.archive(d, path)
    df = A.read(spark, path, "revisit").where((F.col("record_type") == "response") & (F.col("payload_length") >= 100))
    assert df.where("payload is not null").count() == 0
    assert {A_id for (A_id,) in df.select(A.key_of("record_id")).collect()} == {"1", "7", "8", "null"}
    reader = A.WarcReader({"path": path, "payload": "none"})
    from pyspark.sql.datasource import EqualTo, StringContains
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), StringContains(("target_uri",), "a")]))
    assert len(left) == 1 and isinstance(left[0], StringContains)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert {r["record_type"] for r in rows} == {"revisit"} and all(r["payload"] is None for r in rows)


def test_unwanted_payloads_are_not_read(spark, tmp_path):
    d = spark.createDataFrame([(i, "u", os.urandom(200_000).hex()) for i in range(4)], "page_id long, url string, html string").coalesce(1)
    A.archive(d, f"file://{tmp_path}/out")
    (name,) = [x for x in os.listdir(tmp_path / "out") if x.endswith(".gz")]

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def size(self):
            return os.path.getsize(tmp_path / "out" / name)

        def read(self, n):
            x = self.f.read(n)
            self.n += len(x)
            return x

        def seek(self, at):
            self.f.seek(at)

        def tell(self):
            return self.f.tell()
    with open(tmp_path / "out" / name, "rb") as f:
        c = Counting(f)
        assert len([h for _, h, _ in A._Records(c)]) == 4
        assert c.n < c.size() / 2


def test_reads_plain_and_foreign_members(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    block = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"body" * 5000

    def raw(i):
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-record:{i}>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"
    (tmp_path / "in" / "a.warc").write_bytes(raw(1) + raw(2))
    (tmp_path / "in" / "b.warc.gz").write_bytes(gzip.compress(raw(3)) + gzip.compress(raw(4)))
    for mode, want in (("all", b"body" * 5000), ("none", None)):
        got = A.read(spark, f"file://{tmp_path}/in", mode).collect()
        assert sorted(r.record_id for r in got) == [f"<urn:x-record:{i}>" for i in (1, 2, 3, 4)]
        assert all((bytes(r.payload) if r.payload is not None else None) == want for r in got)


def test_only_committed_files_count_and_empty_table(spark, tmp_path):
    d = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    A.archive(d, f"file://{tmp_path}/out")
    (tmp_path / "out" / "lost.warc.gz").write_bytes(b"a task that never committed")
    assert A.read(spark, f"file://{tmp_path}/out").count() == 1
    A.archive(d.limit(0), f"file://{tmp_path}/none")
    assert A.read(spark, f"file://{tmp_path}/none").count() == 0
