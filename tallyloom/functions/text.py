"""Scalar text and calendar functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
UNDATED = "undated"
JOINER = " … "
EIGHTHS = ("", "▏", "▎", "▍", "▌", "▋", "▊", "▉")
DIFF_LIMIT = 60_000
MARKS = {"new": "+", "deepened": "↑", "regressed": "↓", "removed": "−"}


def instant(iso: Column) -> Column:
    """The moment of an ISO text, its offset respected; null where it isn't one."""
    return F.coalesce(F.try_to_timestamp(iso), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))


def week_of(ts: Column) -> Column:
    """The Monday (UTC) of the week, as text; ``undated`` for null."""
    return F.coalesce(F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd"), F.lit(UNDATED))


def month_of(week: Column) -> Column:
    """The month of a week is that of its Monday."""
    return F.substring(week, 1, 7)


def short(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def since(window: Column, now: Column) -> Column:
    """The start of a window like ``90d``, ``2w``, ``6m``, ``1y`` or ``all`` before ``now``; null for other texts."""
    n = F.regexp_extract(window, r"^([0-9]{1,6})[dwmy]\z", 1).try_cast("int")
    unit = F.regexp_extract(window, r"^[0-9]{1,6}([dwmy])\z", 1)
    of = lambda u: F.when(unit == u, n).otherwise(0)
    back = now - F.make_interval(years=of("y"), months=of("m"), weeks=of("w"), days=of("d"))
    return F.when(window == "all", F.lit("1970-01-01").cast("timestamp")).when(n.isNotNull(), back)


def git_since(window: Column) -> Column:
    """The same window as git spells it; other texts as they are."""
    n, unit = F.regexp_extract(window, r"^([0-9]+)[dwmy]\z", 1), F.regexp_extract(window, r"^[0-9]+([dwmy])\z", 1)
    name = F.element_at(F.create_map(*[F.lit(x) for kv in {"d": "days", "w": "weeks", "m": "months", "y": "years"}.items() for x in kv]), unit)
    return F.when(window == "all", "1970-01-01").when(n != "", F.concat(n, F.lit(" "), name, F.lit(" ago"))).otherwise(window)


def bar(n: Column, top: Column, width: int) -> Column:
    """A bar of up to ``width`` cells in eighths; anything over zero shows."""
    eighths = F.greatest(F.lit(1), F.floor(F.least(n, top).cast("double") / top * width * 8 + 0.5).cast("int"))
    drawn = F.concat(F.repeat(F.lit("█"), F.floor(eighths / 8).cast("int")), F.element_at(F.array(*map(F.lit, EIGHTHS)), (eighths % 8 + 1).cast("int")))
    return F.when((n > 0) & (top > 0), drawn).otherwise("")


def cap_mark(change: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), change), F.lit(MARKS["removed"]))


def truncated(text: Column, most: int, both_ends: bool = False) -> Column:
    """At most ``most`` characters: the head, or two thirds head and one third tail around a joiner."""
    n = F.length(text)
    if not both_ends:
        return F.when(n > most, F.substring(text, 1, most)).otherwise(text)
    room = max(0, most - len(JOINER))
    head = room * 2 // 3
    tail = room - head
    joined = F.concat(F.substring(text, 1, head), F.lit(JOINER), F.substring(text, n - tail + 1, F.lit(tail)))
    return F.when(n <= most, text).when(F.length(joined) < n, joined).otherwise(F.substring(text, 1, most))


def cut_diff(diff: Column, limit: int = DIFF_LIMIT) -> Column:
    """At most ``limit`` characters, ended on a line break; empty if the first line is longer."""
    head = F.substring(diff, 1, limit)
    back = F.locate("\n", F.reverse(head))
    return F.when(F.length(diff) <= limit, diff).when(back > 0, F.substring(head, F.lit(1), F.length(head) - back + 1)).otherwise("")


def lines_in(text: Column) -> Column:
    return F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def cut_for_judge(diff: Column, limit: int = DIFF_LIMIT, tool: str = "tallyloom") -> Column:
    """``cut_diff`` with a line that says how many lines are left and how many went."""
    kept = cut_diff(diff, limit)
    there = F.when(kept == "", 0).otherwise(lines_in(kept))
    said = F.concat(F.lit(f"[diff truncated by {tool} at "), there.cast("string"), F.lit(" lines; "), (lines_in(diff) - there).cast("string"), F.lit(" lines omitted]\n"))
    return F.when(F.length(diff) <= limit, diff).otherwise(F.concat(kept, said))


def dedent(lines: Column) -> Column:
    """Lines without the indent that all non-blank ones share."""
    indent = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(x) - F.length(F.regexp_replace(x, r"^[ \t]+", ""))))
    return F.transform(lines, lambda x: F.substring(x, F.coalesce(indent, F.lit(0)) + 1, F.length(x)))


def github_target(text: Column) -> Column:
    """struct(owner, repo, url) of a GitHub address in its usual spellings; null for anything else."""
    pattern = r"^(?:https://)?(?:www\.)?github\.com/([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+?)(?:\.git)?/?\z"
    t = F.trim(text)
    owner, repo = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    ok = t.rlike(pattern) & ~owner.isin(".", "..") & ~repo.isin(".", "..")
    return F.when(ok, F.struct(owner.alias("owner"), repo.alias("repo"), F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit(".git")).alias("url")))


def report_name(number: Column, label: Column) -> Column:
    """``NNN-<slug>.json``: a report's file, the slug the last 80 characters of the label's plain characters."""
    slug = F.regexp_replace(label, "[^A-Za-z0-9._-]+", "_")
    return F.format_string("%03d-%s.json", number, F.right(slug, F.lit(80)))


def untrusted_mark(text: Column) -> Column:
    """A marker that cannot be guessed from outside and isn't in the text: the head of the digest of the text, or of the text and a number."""
    tries = [F.substring(F.sha2(text if i == 0 else F.concat(text, F.lit(f"\x00{i}")), 256), 1, 24) for i in range(4)]
    return F.coalesce(*(F.when(~text.contains(t), t) for t in tries))


def unquoted(text: Column) -> Column:
    """A literal's text without the quotes around it, raw ones included."""
    raw = r'(?s)^r(#*)"(.*)"\1\z'
    first = F.substring(text, 1, 1)
    quoted = (F.length(text) >= 2) & first.isin('"', "'", "`") & text.endswith(first)
    return F.when(text.rlike(raw), F.regexp_extract(text, raw, 2)).when(quoted, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)


def collapsed(text: Column, most: int = 60) -> Column:
    """One line with single blanks, cut to ``most`` characters with an ellipsis."""
    one = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 1), F.lit("…"))).otherwise(one)


def first_token(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\S*)", 1)


def cache_key(*parts: Column) -> Column:
    """Sixteen digits of the digest of the parts, a NUL between them."""
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 16)
