"""Small corpora for the tests, and brute-force versions of what the operators promise."""

import collections
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside, as extra columns of their input.
CLASHING = ("row", "key", "part", "node", "n", "bands", "rng", "size", "tokens", "deal", "mentions", "found", "base", "t", "_row", "length", "hub", "bag", "digest", "_spots", "_spots_row")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", ".", ","]) for _ in range(n))


def edited(rng, text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def odd_texts():
    """Null, empty, blank, very short, very long, other scripts, NUL and lone quotes, repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 40_000, 20_000)
    return [None, "", "   \n\t ", "one", "two words here", long, "日本語 テキスト " * 30, "a\x00b 'q\" \\", "same text " * 60, "same text " * 60, "e" * 30_000, "🙂 " * 200, "line\n" * 80]


def documents(spark, texts, extra=True):
    """doc_id, text, lang, source, n_chars; the last id null, and columns with clashing names."""
    rows = [(i if i < len(texts) - 1 else None, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        rows = [(*r, *range(len(CLASHING))) for r in rows]
        schema += "".join(f", `{c}` int" for c in CLASHING)
    return spark.createDataFrame(rows, schema)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def bag(text, k=5):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] if w else []
    return {(g, i) for g, n in collections.Counter(grams).items() for i in range(n)}


def classes(texts):
    """The least index that each text hangs together with by links of similarity 0.8."""
    bags, up = [bag(t) for t in texts], list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if a and b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(texts))]
