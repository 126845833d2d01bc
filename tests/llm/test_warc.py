import gzip
import hashlib
import random
from pathlib import Path

from remembra.llm._store import workspace
from remembra.llm.warc import read_warc, warc_round_trip, write_warc


def pages():
    r = random.Random(5)
    bodies = ["<p>" + "".join(r.choice("abc é𝄞") for _ in range(n)) for n in (990, 1200, 5000, 200000)] + [None, "", "small"]
    rows = [(i, f"http://h/{i}" if i % 9 else None, bodies[(i * i) % 7], "x") for i in range(90)]
    return rows + [(89, "http://h/89", rows[89][2], "x"), (5, "http://other", "another payload", "y"), (None, "http://null", bodies[2], "z")]


def brute(rows):
    data = [(i, (h or "").encode()) for i, _, h, _ in rows]
    top = {}
    for i, b in data:
        if i is not None:
            top[b] = max(top.get(b, -1), i)
    n, out = {}, []
    for i, b in data:
        first = not n.get((i, b))
        n[i, b] = 1
        visit = len(b) >= 1000 and not (i == top[b] and first)
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if visit else "response", top[b] if visit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    assert sorted(map(tuple, warc_round_trip(df).collect()), key=str) == brute(rows)
    assert warc_round_trip(df.filter("false")).count() == 0


def test_same_bytes_and_rolling(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    made = []
    for d in (df, df.repartition(5)):
        folder = workspace(spark, "t")
        write_warc(d, folder, roll=20_000)
        at = Path(folder.removeprefix("file:"))
        made.append({p.name: p.read_bytes() for p in (at / "data").glob("*.gz")})
        assert not (at / "tmp").exists()
        bodies = {r.page_id: bytes(r.payload) for r in read_warc(spark, folder, payload=True).collect() if r.record_type == "response"}
        assert all(bodies[i] in [(x[2] or "").encode() for x in rows if x[0] == i] for i in bodies)
    assert made[0] == made[1] and len(made[0]) > 1
    assert all(gzip.decompress(b).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for b in made[0].values())


def test_ranges_are_even_whatever_the_ids(spark, monkeypatch):
    r = random.Random(9)
    body = lambda k: f"{k} " + "".join(r.choice("abcdefgh ") for _ in range(r.randint(20, 400)))
    monkeypatch.setattr("remembra.llm.warc.RANGE_BYTES", 4000)
    monkeypatch.setattr("remembra.llm.warc.STEPS", 100)
    rows = [(k, "u", body(k), "d") for k in range(300)] + [(10**15, "u", body(0), "d"), (-(2**63) + 1, "u", "low", "d"), (2**63 - 1, "u", "high", "d")]
    rows += [(77, f"u{k}", body(k), "d") for k in range(200)] + [(None, None, body(k), "d") for k in range(100)]
    made = []
    for d in (3, 7):
        folder = workspace(spark, "t")
        manifest = write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(d), folder).collect()
        at = Path(folder.removeprefix("file:"))
        made.append({p.name: p.read_bytes() for p in (at / "data").glob("*.gz")})
        assert {m.name for m in manifest} == set(made[-1]) and sum(m.records for m in manifest) == len(rows)
    assert made[0] == made[1]
    total = sum(len(x[2]) for x in rows)
    assert total // 4000 <= len(made[0]) <= total // 4000 + 1
    got = read_warc(spark, folder, payload=True).collect()
    assert sorted((x.page_id is not None, x.page_id or 0, bytes(x.payload)) for x in got) == sorted((i is not None, i or 0, h.encode()) for i, _, h, _ in rows)
    # no range is larger than it should be by more than an even piece of the digests
    assert max(m.records for m in manifest) < 80
