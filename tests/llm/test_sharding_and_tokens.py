import collections
import random
import zlib

from tallyloom.llm import encode, sharding, tokens

from .helpers import documents, empty, odd_texts, prose


def test_shards_are_even_gapless_and_whole(spark):
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(900)] + [prose(rng, 120)] * 500 + odd_texts()
    out = sharding.shard(documents(spark, texts), ranges=256).collect()
    assert len(out) == len(texts) and {r["law"] for r in out} == {"bytes"}
    by = {r["doc_id"]: r for r in out}
    for i, t in enumerate(texts[:-1]):
        raw = (t or "").encode()
        assert by[i]["size"] == len(raw) + 1 and by[i]["text_crc32"] == zlib.crc32(raw)
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in out)
    assert set(slots) <= set(range(16)) and max(sizes.values()) <= sum(sizes.values()) / 16 + largest
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(documents(spark, texts), ranges=256).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in out}
    assert sharding.shard(empty(spark)).count() == 0


def test_histogram_answers_every_limit(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(80)] + odd_texts()
    hist = tokens.histogram(documents(spark, texts), block=16)
    ids_of = encode.encoder(encode.default_file())
    n = sorted(len(ids_of(t or "")) for t in texts)
    rows = {r["length"]: r for r in hist.collect()}
    assert sorted(rows) == sorted(set(n))
    for length, r in rows.items():
        longer = [x for x in n if x > length]
        assert (r["n_docs"], r["n_tokens"], r["docs_longer"], r["tokens_longer"]) == (n.count(length), n.count(length) * length, len(longer), sum(longer))
        assert r["truncated_tokens"] == sum(min(x, length) for x in n) and (r["total_docs"], r["total_tokens"]) == (len(n), sum(n))
    for q in (0.1, 0.5, 0.99):
        want = next(x for x in n if sum(y <= x for y in n) >= q * len(n))
        assert tokens.quantile(hist, q).first()["length"] == want
    assert tokens.truncated_total(hist, 37).first()["tokens"] == sum(min(x, 37) for x in n)
    assert tokens.histogram(empty(spark)).count() == 0
