import collections
import itertools
import math
import random
import re
import time

import numpy as np

from tallyloom.llm import decontam, quality, substring, urls
from tallyloom.llm.decontam import Index, closest, fold

from tallyloom.llm.textblock import Block

from .helpers import WORD, documents, edited, empty, odd_texts, prose


def plain(text):
    """The counts of one text, by definition."""
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_against_definitions(spark):
    rng = random.Random(8)
    texts = [prose(rng, rng.randint(0, 200), 30) for _ in range(40)] + [prose(rng, 80) + " ###" * 40, "ab " * 100, prose(rng, 90).upper()] + ["x y z\n" * 3 + prose(rng, 100)] + odd_texts()
    out = {r["doc_id"]: r for r in quality.cascade(documents(spark, texts)).collect()}
    for i, t in enumerate(texts[:-1]):
        r, want = out[i], plain(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r["kept"] and r["base_failed"])
    assert out[40]["base_failed"] is False and out[40]["kept"] is False and out[42]["kept"] is False
    docs = documents(spark, texts)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == [i for i in range(len(texts) - 1) if out[i]["kept"]]
    assert quality.cascade(empty(spark)).count() == 0 and quality.keep(empty(spark)).count() == 0


def test_order_of_rules_goes_by_rejection_per_cost_and_changes_no_verdict():
    rules = quality.RULES
    order = quality.ordered(rules, [(r.name, 1.0 + i, 0.5 if i == 3 else 0.1) for i, r in enumerate(rules)])
    assert order[0].name == rules[3].name
    rng = random.Random(1)
    texts = [prose(rng, rng.randint(0, 120), 20) for _ in range(60)]
    assert ((quality.verdicts(Block(texts), rules) < 0) == (quality.verdicts(Block(texts), rules[::-1]) < 0)).all()


def test_part_of_a_block_is_the_block_of_the_part():
    rng = random.Random(41)
    texts = [prose(rng, rng.randint(0, 60), 9) + rng.choice(["", "\n", " \U00010400\U00010428 É"]) for _ in range(40)] + [None, "", " "]
    for which in ([], [0, 3, 40, 41], range(0, 43, 2), range(43)):
        which, whole = np.array(which, int), Block(texts)
        want = Block([texts[i] for i in which])
        whole.hashes, whole.n_words, quality.letters(whole)  # noqa: B018
        part = whole.take(which)
        assert part.chars.tolist() == want.chars.tolist() and part.hashes.tolist() == want.hashes.tolist() and part.n_words.tolist() == want.n_words.tolist()
        assert [w.tolist() for w in part.words] == [w.tolist() for w in want.words] and quality.letters(part).tolist() == quality.letters(want).tolist()
        assert quality.repeat_words(part).tolist() == quality.repeat_words(want).tolist()


def least(p, t):
    prev = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        cur = [i + 1]
        for j, y in enumerate(t):
            cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev), prev.index(min(prev))


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(800):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, b))) for a, b in ((1, 20), (0, 40)))
        d, e = least(p, t)
        got = closest(decontam._masks(p), len(p), t, len(p))
        assert got is None and d > len(p) or got[0] == d and (d == len(p) or got[1] == e)


def test_leaks_found_up_to_the_budget_and_no_others(spark):
    rng = random.Random(3)
    items = [prose(rng, 30, 5000) for _ in range(20)] + [None, "", "  "]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    hidden = {}
    texts = []
    for i in range(20):
        chars = list(items[i])
        for _ in range(int(len(chars) * 0.05) if i % 2 else 0):
            chars[rng.randrange(len(chars))] = rng.choice(["", "q", "qz"])
        hidden[len(texts)] = i
        texts.append(prose(rng, 40, 5000) + " " + "".join(chars).replace(" ", "\n" if i % 3 else " ").upper() + " " + prose(rng, 40, 5000))
    texts += [prose(rng, 100, 5000) for _ in range(20)] + odd_texts()
    index = Index([(i, fold(t)) for i, t in enumerate(items[:20])], 0.1)
    out = decontam.leaks(documents(spark, texts), bench, block_chars=1000).collect()
    got = {(r["doc_id"], r["item_id"]) for r in out}
    want = {(d, i) for d, i in hidden.items() if least(fold(items[i]), fold(texts[d]))[0] <= int(len(items[i]) * 0.1)}
    assert got == want and len(want) >= 18
    for r in out:
        assert least(fold(items[r["item_id"]]), fold(texts[r["doc_id"]])[r["start"] : r["end"]])[0] == r["edits"]
    docs = documents(spark, texts)
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and clean.count() == len(texts) - len({d for d, _ in want})
    assert index.roots and decontam.leaks(empty(spark), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_are_found_as_they_are_at_word_edges(spark):
    rng = random.Random(33)
    items = ["x", "Éa", "two words", "is 12 of it", "a sentence of twenty-nine chs"]
    texts = ["x", "xy x-ray, x", "a Two\tWords.", "two  words", "twowords two wordsy", "that IS 12 of it", "so this 12 of it", "ÉA éab", items[4], items[4].replace("y", "i"), "x " * 60_000]
    texts += [" ".join(rng.choice(["x", "xy", "two", "words", "éa", "12", "is", "of", "it"]) for _ in range(30)) for _ in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["start"], r["end"]) for r in decontam.leaks(documents(spark, [*texts, None]), bench).collect()}
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            f, x = fold(t), fold(item)
            want |= {(d, i, p, p + len(x)) for p in (m.start() for m in re.finditer(f"(?={re.escape(x)})", f)) if not f[p - 1 : p].isalnum() and not f[p + len(x) : p + len(x) + 1].isalnum()}
    assert got == want and len(want) > 60_000


def test_repeated_passages_found_wherever_they_stand(spark):
    rng = random.Random(4)
    passage = [prose(rng, rng.randint(55, 90), 5000) for _ in range(15)]
    texts = []
    for p in passage:
        texts += [prose(rng, rng.randint(3, 80), 5000) + " " + p + " " + prose(rng, rng.randint(3, 80), 5000) for _ in range(3)]
    n = len(texts)
    texts += ["to " * 90 + prose(rng, 40, 5000), prose(rng, 33, 5000) + " " + "to " * 90]
    clean = len(texts)
    texts += [prose(rng, 150, 5000) for _ in range(40)] + odd_texts()
    out = substring.repeats(documents(spark, texts)).collect()
    found = {r["doc_id"] for r in out}
    assert set(range(n)) <= found and {n, n + 1} <= found
    assert not found & set(range(clean, clean + 40))
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < n:
            part = texts[r["doc_id"]][r["start"] : r["end"]]
            assert any(part in t for i, t in enumerate(texts) if i != r["doc_id"] and t)
    assert sum(r["kept"] for r in out if r["doc_id"] is not None and r["doc_id"] < n) >= 10
    assert substring.repeats(empty(spark)).count() == 0


def test_each_chunk_keeps_its_first_copy_beside_a_frequent_line(spark):
    rng = random.Random(14)
    line, passage = prose(rng, 60, 5000), prose(rng, 80, 5000)
    texts = [line] + [f"{prose(rng, 40, 5000)} {line} {passage} {prose(rng, 40, 5000)}" for _ in range(4)]
    docs = documents(spark, [*texts, None])
    spots = collections.defaultdict(list)
    for r in substring.repeats(docs).collect():
        spots[r["doc_id"]].append((r["start"], r["end"], r["kept"]))
    cut = []
    for i, t in enumerate(texts):
        for a, e, kept in sorted(spots[i], reverse=True):
            t = t if kept else t[:a] + t[e:]
        cut.append(t)
    assert cut[0] == line and sum(passage[30:-30] in t for t in cut) == 1 and passage[30:-30] in cut[1]
    assert not any(line[30:-30] in t for t in cut[1:]) and {k for _, _, k in spots[1]} == {True, False}


def after_cutting(spark, texts):
    """The texts without the runs that aren't kept."""
    spots = collections.defaultdict(list)
    for r in substring.repeats(documents(spark, [*texts, None])).collect():
        spots[r["doc_id"]].append((r["start"], r["end"], r["kept"]))
    out = []
    for i, t in enumerate(texts):
        for a, e, kept in sorted(spots[i], reverse=True):
            t = t if kept else t[:a] + t[e:]
        out.append(t)
    return out


def test_chained_passages_keep_a_copy(spark):
    rng = random.Random(15)
    p, q, r, s = (prose(rng, 70, 5000) for _ in range(4))
    orders = [[p + " " + q, p + " " + q + " " + r, q + " " + r], [q + " " + r, p + " " + q, r + " " + s + " " + p, s + " " + q]]
    for texts in orders:
        texts = [f"{prose(rng, 20, 5000)} {t} {prose(rng, 20, 5000)}" for t in texts]
        cut = after_cutting(spark, texts)
        for x in (p, q, r, s):
            held = sum(x in t for t in texts)
            # A chunk's first copy stays, so each stretch of the passage is left once; parts may stay in different documents.
            windows = [x[i : i + 40] for i in range(60, len(x) - 100, 20)]
            assert all(any(w in t for t in cut) for w in windows) or not held
            assert held < 2 or sum(w in t for w in windows for t in cut) <= len(windows) + 2


def plain_shared(texts):
    """Chunks (text, start, end) that several texts hold, with the first text that holds them; by the chunker's own cuts."""
    own = []
    for t in texts:
        a, e = substring.chunks(Block([t]))
        own.append([(int(x), int(y)) for x, y in zip(a, e)])
    holders = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for a, e in own[i]:
            holders[t[a:e]].add(i)
    return own, {c: min(h) for c, h in holders.items() if len(h) > 1}


def test_runs_and_kept_against_brute_force(spark):
    rng = random.Random(19)
    lines = [prose(rng, rng.randint(20, 70), 5000) for _ in range(6)]
    texts = [" ".join(rng.choice([prose(rng, rng.randint(5, 60), 5000), rng.choice(lines), rng.choice(lines)]) for _ in range(4)) for _ in range(40)]
    own, first = plain_shared(texts)
    want = set()
    for i, t in enumerate(texts):
        words, chunks = [m.span() for m in WORD.finditer(t)], own[i]
        at = [k for k, (a, e) in enumerate(chunks) if t[a:e] in first]
        runs = []
        for k in at:
            runs[-1].append(k) if runs and runs[-1][-1] == k - 1 else runs.append([k])
        for run in runs:
            low = chunks[run[0] - 1][0] if run[0] else 0
            high = chunks[run[-1] + 1][1] if run[-1] + 1 < len(chunks) else len(t)
            reach = sum(a < high for a, _ in words) - max(0, sum(a <= low for a, _ in words) - 1)
            if reach < substring.LEAST_WORDS or chunks[run[-1]][1] - chunks[run[0]][0] < substring.LEAST_CHARS:
                continue
            parts = []
            for k in run:
                kept = first[t[chunks[k][0] : chunks[k][1]]] == i
                parts[-1][1].append(k) if parts and parts[-1][0] == kept else parts.append((kept, [k]))
            want |= {(i, chunks[ks[0]][0], chunks[ks[-1]][1], len(ks), kept) for kept, ks in parts}
    got = {tuple(r) for r in substring.repeats(documents(spark, [*texts, None])).collect()}
    assert got == want and len(want) > 40 and {k for *_, k in want} == {True, False}


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("allow", "example.net", "/de/8"), ("block", "org", "/es/")]


def url_parts(u):
    if not u or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail.split("?")[0].split("#")[0]


def test_urls_rules_and_mined_rules(spark):
    rng = random.Random(5)
    pages = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7x?y", "https://example.com", "http://xexample.com/en/7", "http://b.example.net/de/8#f://g", "x://net/de/", "ftp://org/es/?q", "http://É.org/es/", "http://a.org?/es/", "http://h/\nen"]
    pages += [f"http://{rng.choice(['spam', 'good', 'shop'])}{rng.randrange(3)}.{rng.choice(['example.com', 'example.net', 'site.org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(900)}" for _ in range(400)] * 2
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(pages)], "page_id long, url string, host string, row int")
    out = {r["page_id"]: r for r in urls.judge(df).collect()}
    assert len(out) == len(pages)
    for i, u in enumerate(pages):
        host, path = url_parts(u)
        fits = [(v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[1]), default=(None, None))
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, best[1]), u
        assert out[i]["verdict"] == best[0] if best[0] else out[i]["verdict"] in ("allow", "block")
        assert out[i]["mined"] is None or out[i]["rule"] is None
    assert out[0]["verdict"] == out[2]["verdict"] == "allow"
    assert urls.judge(df.limit(0)).count() == 0


def test_undecided_pages_are_not_blocked_for_how_the_rules_pick(spark):
    made = [f"http://h{i}.org/{'es' if i % 10 == 0 else 'fr'}/{i}" for i in range(200)] + [f"http://good{i}.example.com/en/7{i}" for i in range(20)]
    made += [f"http://spam.net/de/{i}" for i in range(40)] + ["http://spam.net/fr/1"]
    out = urls.judge(spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id long, url string")).collect()
    undecided = {r["host"]: r["verdict"] for r in out if r["rule"] is None}
    assert len(undecided) == 181 and [h for h, v in undecided.items() if v == "block"] == ["spam.net"]


def test_mining_keeps_sure_and_short_rules(spark):
    rows = [(["word:spam", "path:a"], "block")] * 20 + [(["word:spam", "path:b"], "block")] * 20 + [(["word:good", "path:a"], "allow")] * 40
    rules = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), support=0.05, confidence=0.9).collect()
    assert [r["needs"] for r in rules] == [["path:b"], ["word:spam"]] or [r["needs"] for r in rules] == [["word:spam"], ["path:b"]]


def plain_rules(rows, support, confidence, longest):
    """needs: confidence of the rules that stay, by definition."""
    n, share, least = len(rows), sum(v == "block" for _, v in rows) / len(rows), max(1, math.ceil(support * len(rows) - 1e-9))
    held, blocked = collections.Counter(), collections.Counter()
    for items, v in rows:
        for k in range(1, longest + 1):
            for c in itertools.combinations(sorted(set(items)), k):
                held[c] += 1
                blocked[c] += v == "block"
    sure = {c: blocked[c] / m for c, m in held.items() if blocked[c] >= least and blocked[c] / m >= confidence and blocked[c] / m > share}
    return {c: p for c, p in sure.items() if not any(sure.get(s, -1) >= p for k in range(1, len(c)) for s in itertools.combinations(c, k))}, n


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(31)
    for case in range(3):
        rows = [([f"t{rng.randrange(9)}" for _ in range(rng.randint(0, 7))], None) for _ in range(400)]
        rows = [(list(dict.fromkeys(x)), rng.choice(["block", "allow", None]) if rng.random() < 0.15 else "block" if {"t1", "t2"} <= set(x) or "t3" in x and "t4" not in x else "allow") for x, _ in rows]
        want, _ = plain_rules(rows, 0.01, 0.8 - 0.1 * case, 4)
        df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
        for wide in (10, 0):
            got = {tuple(r["needs"]): r["confidence"] for r in urls.mine(df, support=0.01, confidence=0.8 - 0.1 * case, wide=wide).collect()}
            assert set(got) == set(want) and len(want) > 2 and all(abs(got[c] - want[c]) < 1e-9 for c in want)


def test_many_tokens_that_come_together_end_soon(spark):
    rng = random.Random(32)
    many = [f"path:s{i}" for i in range(60)]
    rows = [(many + [f"word:w{rng.randrange(50)}"], "block") for _ in range(200)] + [([f"path:s{rng.randrange(60)}", "word:w1"], "allow") for _ in range(20)]
    began = time.time()
    got = {tuple(r["needs"]): r["confidence"] for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string")).collect()}
    assert time.time() - began < 30
    assert got == plain_rules(rows, urls.SUPPORT, urls.CONFIDENCE, 2)[0] and len(got) > 60
    pages = spark.createDataFrame([(i, "http://h.net/de/" + "/".join(f"s{chr(97 + j % 26)}{'x' * (j // 26)}" for j in range(60))) for i in range(300)], "page_id long, url string")
    assert urls.judge(pages).filter("verdict = 'block'").count() == 300 and time.time() - began < 60


def test_edited_helper_changes_words():
    rng = random.Random(0)
    assert edited(rng, "a b c d", 2) != "a b c d"
