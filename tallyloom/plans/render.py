"""A collected report as text, ANSI text, SVG or HTML. Runs on the driver over one report row, whose lists are bounded by what is shown."""

from __future__ import annotations

import html
import re
import unicodedata

# Kinds with their words, colours, widths.
KINDS = (("cap", "caps"), ("fix", "fixes"), ("tend", "tends"))
COLOURS = {"plain": "", "dim": "#8a8f98", "head": "#ffffff", "cap": "#7FB4E6", "fix": "#E8654E", "tend": "#97C09F", "warn": "#e0b34a"}
BLOCKS = ("", "▏", "▎", "▍", "▌", "▋", "▊", "▉")
WIDTH, SHARE = 12, 16

Seg = tuple[str, str]


def bar(n: int, top: int, width: int) -> str:
    if n <= 0 or top <= 0:
        return ""
    e = max(1, int(min(n, top) / top * width * 8 + 0.5))
    return "█" * (e // 8) + BLOCKS[e % 8]


def shared(counts: dict[str, int], cells: int) -> list[tuple[str, int]]:
    """Cells among the kinds that count anything, by largest remainder; each gets one at least."""
    kinds = [k for k, _ in KINDS if counts[k] > 0]
    total = sum(counts[k] for k in kinds)
    if not total:
        return []
    cells = max(cells, len(kinds))
    exact = {k: counts[k] / total * cells for k in kinds}
    out = {k: max(1, int(exact[k])) for k in kinds}
    for k in sorted(kinds, key=lambda k: -(exact[k] % 1)) * cells:
        if sum(out.values()) >= cells:
            break
        out[k] += 1
    while sum(out.values()) > cells:
        out[max(kinds, key=lambda k: out[k])] -= 1
    return [(k, out[k]) for k in kinds]


def shown(name: str) -> str:
    """A name without what has no fixed width."""
    bare = "".join(c for c in unicodedata.normalize("NFC", name) if not (unicodedata.category(c) == "So" or c in "️‍")).strip()
    return bare or name


def clip(text: str, n: int) -> str:
    return text if len(text) <= n else text[: n - 1] + "…"


def mark(change: str) -> Seg:
    return {"new": ("+", "cap"), "deepened": ("↑", "cap"), "regressed": ("↓", "fix")}.get(change, ("−", "fix"))


def months(weeks: list[dict]) -> list[dict]:
    out: dict[str, dict] = {}
    for w in weeks:
        row = out.setdefault(w["week"][:7], {"label": w["week"][:7], **{k: 0 for k, _ in KINDS}})
        for k, _ in KINDS:
            row[k] += w[k]
    return list(out.values())


def lines(r: dict, *, title: str = "tallyloom", most_caps: int = 15, most_authors: int = 10, most_weeks: int = 16) -> list[list[Seg]]:
    """The report as lines of styled segments; what is left out is counted."""
    day = lambda x: (x or "-")[:10]
    cached = f" ({r['cached']} cached)" if r.get("cached") else ""
    out: list[list[Seg]] = [[(title, "cap"), ("  ", "plain"), (r["repo"], "head")], [(f"{day(r['window']['first'])} → {day(r['window']['last'])}  ·  {r['commits']} commits{cached}  ·  judged by {r['mode']} ({r['model']})", "dim")], []]
    row: list[Seg] = [("  ", "plain")]
    for i, (k, word) in enumerate(KINDS):
        row += [("     ", "plain")] * bool(i) + [(str(r["totals"][k]), k), (f" {word}", k)]
    out += [row, []]
    if r["weeks"]:
        by_month = len(r["weeks"]) > most_weeks
        rows = months(r["weeks"]) if by_month else [{**w, "label": w["week"][5:]} for w in r["weeks"]]
        top = {k: max(1, *(x[k] for x in rows)) for k, _ in KINDS}
        out.append([(("month" if by_month else "week of").ljust(11), "dim"), *((word.ljust(WIDTH + 5), k) for k, word in KINDS)])
        for x in rows[-most_weeks:]:
            row = [(x["label"].ljust(11), "dim")]
            for k, _ in KINDS:
                n = x[k]
                drawn = bar(n, top[k], WIDTH) if n > 0 else "◂" if n < 0 else "·"
                row += [(drawn, k if n > 0 else "fix" if n < 0 else "dim"), (" " + (f"−{-n}" if n < 0 else str(n)).ljust(WIDTH + 4 - len(drawn)), "plain" if n > 0 else "fix" if n < 0 else "dim")]
            out.append(row)
        out.append([])
    if r["authors"]:
        some = r["authors"][:most_authors]
        wide = min(24, max(10, *(len(shown(a["author"])) for a in some)) + 2)
        out.append([("by author".ljust(wide), "dim"), ("caps".rjust(6), "cap"), ("fixes".rjust(7), "fix"), ("tends".rjust(7), "tend")])
        top_total = max(1, *(sum(a[k] for k, _ in KINDS) for a in some))
        for a in some:
            row = [(clip(shown(a["author"]), wide - 2).ljust(wide), "plain"), *((str(a[k]).rjust(w), k if a[k] else "dim") for k, w in (("cap", 6), ("fix", 7), ("tend", 7))), ("   ", "plain")]
            out.append(row + [("█" * n, k) for k, n in shared(a, int(sum(a[k] for k, _ in KINDS) / top_total * SHARE + 0.5))])
        if len(r["authors"]) > len(some):
            out.append([(f"+ {len(r['authors']) - len(some)} more authors", "dim")])
        out.append([])
    if r["caps"]:
        some = r["caps"][-most_caps:][::-1]
        out.append([("caps", "cap"), ("  newest first" + (f", {len(some)} of {len(r['caps'])}" if len(r["caps"]) > len(some) else ""), "dim")])
        wide = min(44, max(len(c["name"]) for c in some) + 2)
        out += [[("  ", "plain"), mark(c["change"]), (" ", "plain"), (clip(c["name"], wide - 2).ljust(wide), "plain"), (f"{c['sha']}  {c['author']}", "dim")] for c in some]
        out.append([])
    if r["failed"]:
        out.append([(f"incomplete: {len(r['failed'])} commits could not be judged, so these totals are a lower bound (first: {r['failed'][0]['sha']} {r['failed'][0]['error']})", "warn")])
    if r.get("redactions"):
        out.append([(f"{r['redactions']} secret-shaped strings were redacted before leaving this machine", "dim")])
    while out and not out[-1]:
        out.pop()
    return out


def escaped(text: str) -> str:
    """Control characters as codes, but for tab and line feed."""
    return re.sub("[\x00-\x08\x0b-\x1f\x7f-\x9f]", lambda m: f"\\x{ord(m[0]):02x}", text)


def as_text(styled: list[list[Seg]], colour: bool = False) -> str:
    def seg(s: Seg) -> str:
        text, hue = escaped(s[0]), COLOURS[s[1]]
        return f"\x1b[38;2;{int(hue[1:3], 16)};{int(hue[3:5], 16)};{int(hue[5:7], 16)}m{text}\x1b[0m" if colour and hue else text

    return "\n".join("".join(map(seg, line)).rstrip() for line in styled) + "\n"


def as_html(styled: list[list[Seg]]) -> str:
    span = lambda s: f'<span style="color:{COLOURS[s[1]]}">{html.escape(escaped(s[0]))}</span>' if COLOURS[s[1]] else html.escape(escaped(s[0]))
    return "<pre>" + "\n".join("".join(map(span, line)) for line in styled) + "</pre>"


def as_svg(styled: list[list[Seg]], cell: int = 8, row: int = 18) -> str:
    wide = max((sum(len(t) for t, _ in line) for line in styled), default=1) * cell + 32
    body = []
    for i, line in enumerate(styled):
        at = 16
        for text, style in line:
            body.append(f'<text x="{at}" y="{24 + i * row}" fill="{COLOURS[style] or "#d8dbe0"}" xml:space="preserve">{html.escape(escaped(text))}</text>')
            at += len(text) * cell
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{len(styled) * row + 32}" font-family="monospace" font-size="13"><rect width="100%" height="100%" fill="#14161a"/>{"".join(body)}</svg>'


def page(r: dict, title: str = "tallyloom") -> str:
    """A page of its own: totals with weekly strips, authors and capabilities; long lists fold."""
    esc = lambda x: html.escape(escaped(str(x)))
    cards = []
    for k, word in KINDS:
        top = max(1, *(w[k] for w in r["weeks"])) if r["weeks"] else 1
        strip = "".join(f'<i title="{esc(w["week"])}: {w[k]}" style="height:{max(0, w[k]) * 40 // top}px;background:{COLOURS[k]}"></i>' for w in r["weeks"])
        cards.append(f'<section><b style="color:{COLOURS[k]}">{r["totals"][k]}</b> {word}<div class="strip">{strip}</div></section>')
    fold = lambda rows, n, what: "".join(rows[:n]) + (f"<details><summary>{len(rows) - n} more {what}</summary>{''.join(rows[n:])}</details>" if len(rows) > n else "")
    people = [f"<p>{esc(a['author'])} <small>{a['cap']} · {a['fix']} · {a['tend']}</small></p>" for a in r["authors"]]
    caps = [f"<p>{mark(c['change'])[0]} {esc(c['name'])} <small>{esc(c['sha'])} {esc(c['author'])}</small></p>" for c in r["caps"][::-1]]
    return (
        f"<!doctype html><meta charset=utf-8><title>{esc(title)} {esc(r['repo'])}</title><style>body{{font:15px sans-serif;max-width:60em;margin:2em auto}}.strip{{display:flex;align-items:end;height:40px;gap:2px}}.strip i{{width:8px}}section{{display:inline-block;margin-right:3em}}</style>"
        f"<h1>{esc(r['repo'])}</h1>{''.join(cards)}<h2>authors</h2>{fold(people, 10, 'authors')}<h2>caps</h2>{fold(caps, 24, 'caps')}"
    )
