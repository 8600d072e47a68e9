import base64
import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import copies, packing, tokens


def test_copies(spark):
    texts = ["Biaya Tilang", "biaya  tilang!", "BIAYATILANG", "tilang biaya", "a, b; c", "C/A|b", "2,5 mm", "2.5 mm", "2, 5 mm", "", "...", None, "x"]
    rows = spark.createDataFrame([("t", i + 1, x, 0) for i, x in enumerate(texts)] + [("u", 1, "x", 0), ("u", 1, "x", 0)], "table_name string, id long, term string, keep_id int")
    got = {tuple(r) for r in copies.members(copies.digests(rows, "term", ["table_name", "id"])).collect()}
    assert got == {("t", 1, 2), ("t", 1, 3), ("t", 5, 6), ("t", 10, 11)}
    sizes = {(r.table_name, r.keep_id): r.n for r in copies.groups(copies.digests(rows, "term", ["table_name", "id"])).collect()}
    assert sizes["t", 1] == 3 and sizes["t", 7] == 1 and sizes["u", 1] == 2
    assert copies.members(copies.digests(rows.limit(0), "term", ["table_name", "id"])).count() == 0


TEXTS = ["", "Biaya kabel 4x16 mm²", "don't  stop\n\n\t x", "emoji 😀 全角 кириллица", "<|endoftext|>", "a" * 5000, " ", "\u0000\u0001 tab\t"]


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZERS), reason="no vocabulary files")
def test_tokens(spark):
    import tiktoken

    with open(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = tokens.Encoder(tokens.sentencepiece_model(os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)))
    r = random.Random(2)
    texts = TEXTS + ["".join(chr(r.choice([32, 10, 97, 233, 0x4E00, 0x1F600]) + r.randint(0, 20)) for _ in range(60)) for _ in range(40)]
    for t, ids in zip(texts, enc.encode(texts)):
        assert ids == want.encode_ordinary(t) and enc.decode(ids) == t
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "i int, t string")
    got = {x.i: (x.ids, x.n) for x in df.select("i", tokens.token_ids(spark, F.col("t")).alias("ids"), tokens.token_count(spark, F.col("t")).alias("n")).collect()}
    assert got[0] == ([], 0) and got[len(TEXTS)] == ([], 0) and got[1][0] == want.encode_ordinary(TEXTS[1]) and got[1][1] == len(got[1][0])


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_item_once(seed):
    r = random.Random(seed)
    cap = r.choice([10, 64, 500])
    hist = {s: r.randint(1, 300) for s in r.sample(range(1, cap + 1), min(cap, r.randint(1, 60)))}
    p = packing.plan(hist, cap)
    load, ranks = {}, {}
    for size, first, n, container in p.places:
        for k in range(n):
            load[container + k] = load.get(container + k, 0) + size
            ranks.setdefault(size, []).append(first + k)
    assert {s: sorted(v) for s, v in ranks.items()} == {s: list(range(n)) for s, n in hist.items()}
    assert max(load.values()) <= cap
    spaces = sorted((cap - load.get(c, 0) for c in range(1, p.next)), reverse=True)
    assert len([x for x in spaces if x > cap // 2]) <= 1 or min(hist) > cap // 2  # no two containers could be poured into one
    assert len(load) <= sum(s * n for s, n in hist.items()) / cap * 1.3 + 2 or min(hist) > cap // 3


def test_containers(spark):
    r = random.Random(1)
    data = [(i, r.choice([7, 7, 7, r.randint(1, 60), r.randint(61, 400)])) for i in range(1500)] + [(2000, 0), (2001, None), (2002, 200), (2003, 100), (2004, 100), (2004, 100)]
    df = spark.createDataFrame(data, "item_id long, length long")
    rows = packing.containers(df, 100).collect()
    load, per = {}, {}
    for x in rows:
        load[x.container_id] = load.get(x.container_id, 0) + x.length
        per[x.item_id] = per.get(x.item_id, 0) + x.length
        assert x.start == x.piece_no * 100 and (x.piece_no == 0 or x.length <= 100)
    assert max(load.values()) <= 100 and load[0] == 0
    assert all(per[i] == (n or 0) for i, n in data if i != 2004) and per[2004] == 200
    assert all(len({x.piece_no for x in rows if x.item_id == i}) == 1 for i, n in data[:200] if n <= 100)
    assert packing.containers(df.limit(0), 100).count() == 0


def test_nested_records_are_hashed_from_the_leaves(spark):
    schema = "id long, name string, parts array<struct<code: string, size: string>>, tags map<string, string>, extra string"
    one = ("Kabel, NYY", [("A-1", "4 x 16"), ("B", None)], {"unit": "M", "warna": "Hitam"})
    rows = [
        (1, *one, "a"), (2, "nyy / KABEL", [("b", ""), ("a1", "4x16")], {"WARNA": "hitam", "Unit": "m."}, "b"), (3, "Kabel NYY", *one[1:], None),
        (4, one[0], [("A-1", "4 x 16")], one[2], None), (5, one[0], [("4 x 16", "A-1"), ("B", None)], one[2], None), (6, None, None, None, None), (7, "", [], {}, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = {r.id: (r.root, r.structure) for r in copies.record_digests(df, ["name", "parts", "tags"], ["id"]).collect()}
    assert got[1] == got[2] and len({got[i] for i in (1, 3, 4, 5, 6)}) == 5 and got[6] == got[7]
    assert len({d for d, _ in got.values()}) == len({s for _, s in got.values()}) == 5
    turned = {r.id: (r.root, r.structure) for r in copies.record_digests(df, ["tags", "name", "parts"], ["id"]).collect()}
    assert turned == got


def test_containers_are_full(spark):
    r = __import__("random").Random(2)
    sized = spark.createDataFrame([(i, r.choice([r.randint(1, 400), r.randint(100, 1500), r.randint(1, 5000)])) for i in range(6000)], "item_id long, length long")
    out = packing.containers(sized, 2048)
    used = out.filter("length > 0").groupBy("container_id").sum("length").collect()
    assert max(u[1] for u in used) <= 2048 and sum(u[1] for u in used) >= 0.98 * 2048 * len(used)
