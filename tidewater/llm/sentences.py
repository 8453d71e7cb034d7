"""Problem 9: sentence units of texts in any language or script.

A text is first laid out in blocks: fenced code with its fences, runs of lines
indented by four spaces, list items (marker included), and paragraphs, which end
at blank lines. Code blocks are one unit each. In the others every place after
an end mark is judged by a cascade of break and no-break rules (see
``sentence_rules``); the first rule that matches decides. Places inside a
quotation, a bracket or inline code are not judged, and closing quotes and
brackets stay with the sentence they close.

Tables are those of the block's languages. A script that one language of the
tables uses names it; among those in Latin script the function words of the
block decide, then those of the whole text, then the language column, which may
be missing or wrong; if nothing tells, all tables in Latin script apply. Where a
block has no capitals at all, a table for such blocks comes first.

Edge cases: null, empty and blank texts have no units; a fence that is never
closed runs to the end of the text; text without an end mark runs to the end of
its block; rows that repeat give their units again; an opening mark that is never
closed is text; the work per text is linear in its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sentence_rules as R
from .kept import kept

#: Opening marks by the closing ones; a low mark is closed by either high one.
_OPENERS = {"»": "«", "“": "„", "”": "„“", "」": "「", "』": "『", "）": "（", "》": "《", "】": "【", ")": "(", "]": "["}
_OPENING = set("«„“「『（《【([")


def _compiled():
    return kept(("patterns",), _patterns)


def _patterns():
    import regex

    line = regex.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
    fence = regex.compile(r"\s{0,3}(`{3,}|~{3,})")
    item = regex.compile(r"[^\S\r\n]{0,3}(?:[-*+•‣–]|(\d{1,3})[.)])[^\S\r\n]+(?=\S)")
    quotes = regex.compile(r"`+|[«»„“”「」『』（）《》【】()\[\]\"]")
    latin = regex.compile(r"\p{Latin}")
    # every sentence terminal but the Burmese comma
    marks = regex.compile(rf"(?V1)[[.…．]||{R.TERMINAL}--[၊]]+" r"|(?<=\p{Greek}[`\p{M}]*);|(?:ครับ|ค่ะ|คะ|จ้ะ|จ้า)(?=\s)|[๚๛]|(?:[\p{Emoji_Presentation}️]|(?<=\s)(?:\^\^|[:;]-?[)(DP]))(?=\s+\p{Lu})")
    scripts: dict[str, list[str]] = {}
    for code, language in R.LANGUAGES.items():
        scripts.setdefault(language.script, []).append(code)
    scripts = [(regex.compile(pattern), tuple(codes)) for pattern, codes in scripts.items()]
    words = {w: c for c, t in reversed(R.LANGUAGES.items()) for w in t.function_words}
    return line, fence, item, regex.compile(r"\p{Lu}"), words, quotes, latin, marks, scripts


def _told(text: str) -> dict[str, int]:
    """Function words of each language in Latin script."""
    words = _compiled()[4]
    out: dict[str, int] = {}
    for w in text.lower().split():
        if code := words.get(w):
            out[code] = out.get(code, 0) + 1
    return out


def _leading(counts: dict[str, int]) -> tuple[str, ...]:
    """The language with most function words, and others with over half as many."""
    most = max(counts.values(), default=0)
    return tuple(c for c in R.LANGUAGES if counts.get(c, 0) * 2 > most) if most else ()


def languages(body: str, whole: Callable[[], tuple[str, ...]], stated: str | None) -> tuple[str, ...]:
    """Codes of the tables that apply to a block. ``whole`` gives the languages
    that the function words of its text tell, ``stated`` is the language column."""
    *_, scripts = _compiled()
    out: tuple[str, ...] = ()
    for pattern, codes in scripts:
        if not pattern.search(body):
            continue
        if len(codes) > 1:
            codes = _leading(_told(body)) or whole() or ((stated,) if stated in codes else codes)
        out += codes
    return tuple(c for c in out if c != "zh") if "ja" in out else out


def _cascade(codes: tuple[str, ...], small: bool):
    """The cascade with neighbouring rules of one kind joined to one pattern."""
    return kept(("cascade", codes, small), lambda: _joined_rules(codes, small))


def _joined_rules(codes: tuple[str, ...], small: bool):
    import regex

    groups: list[tuple[bool, list[str]]] = []
    for stop, before, after in R.cascade(codes, small):
        pattern = (f"(?<={before})" if before else "") + (f"(?={after})" if after else "")
        if groups and groups[-1][0] == stop:
            groups[-1][1].append(pattern)
        else:
            groups.append((stop, [pattern]))
    return [(stop, regex.compile("|".join(f"(?:{p})" for p in patterns))) for stop, patterns in groups]


def blocks(text: str) -> list[tuple[int, int, int]]:
    """(start, end, skip): blocks in order. ``skip`` is the length of a list
    marker, or -1 for code, which is one unit."""
    line, fence, item, *_ = _compiled()
    out: list[tuple[int, int, int]] = []
    start = skip = -1  # of the open paragraph or item
    kind = ""  # "", "text", "item", "indent" or the open fence
    begun = 0

    def close(end: int) -> None:
        nonlocal kind, start
        if kind == "indent":
            out.append((start, end, -1))
        elif kind in ("text", "item"):
            out.append((start, end, skip))
        kind = ""

    for m in line.finditer(text):
        a, b = m.span()
        if a == b:
            break
        body = m.group()
        if kind[:1] in ("`", "~"):
            mark = body.strip()
            if len(mark) >= len(kind) and set(mark) == {kind[0]}:
                out.append((begun, b, -1))
                kind = ""
            continue
        if not body.strip():
            close(a)
            continue
        f = fence.match(body)
        if f:
            close(a)
            kind, begun = f.group(1), a
            continue
        if body.startswith("    ") and kind in ("", "indent"):
            if kind == "":
                kind, start = "indent", a
            continue
        i = item.match(body)
        if i and kind == "text" and i.group(1) not in (None, "1"):
            i = None  # a wrapped line that happens to start with a number
        if i:
            close(a)
            kind, start, skip = "item", a, i.end()
        elif kind in ("", "indent"):
            close(a)
            kind, start, skip = "text", a, 0
    if kind[:1] in ("`", "~"):
        out.append((begun, len(text), -1))
    else:
        close(len(text))
    return out


def spans(body: str, skip: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the outermost quotations, brackets and inline code, of
    any length and depth, by one pass with a stack. A closing mark drops what was
    opened after its opening mark and never closed."""
    *_, quotes, latin, _, _ = _compiled()
    marks = [[m.start(), m.end()] for m in quotes.finditer(body, skip)]
    runs = [m for m in marks if body[m[0]] == "`"]
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    open_ = dict.fromkeys([*_OPENING, '"'], 0)  # how many of each are on the stack
    straight, run, done = -1, 0, 0

    def close(kinds: str, end: int) -> None:
        nonlocal straight
        while stack:
            kind, at = stack.pop()
            if kind == '"' and at != straight:
                continue  # given up before
            open_[kind] -= 1
            if kind == '"':
                straight = -1
            if kind in kinds:
                if end - at > 2:
                    found.append((at, end))
                return

    for mark in marks:
        i, end = mark
        if i == end:  # a run used up by the one before
            run += 1
            continue
        c = body[i]
        if c == "`":
            run += 1
            if run < len(runs):
                n = min(end - i, runs[run][1] - runs[run][0])
                done = runs[run][0] + n
                found.append((end - n, done))
                runs[run][0] = done  # what is left of a longer run may open again
        elif i < done:  # within inline code
            continue
        elif c == '"':
            if straight >= 0:
                if i - straight > 1 and not body[i - 1].isspace() and not latin.match(body, end):
                    close(c, end)
                    continue
                straight, open_[c] = -1, 0
            if (i == 0 or body[i - 1].isspace() or body[i - 1] in "([«„“「") and end < len(body) and not body[end].isspace():
                stack.append((c, i))
                straight, open_[c] = i, 1
        elif c in _OPENERS and any(open_[k] for k in _OPENERS[c]):
            close(_OPENERS[c], end)
        elif c in _OPENING:
            stack.append((c, i))
            open_[c] += 1
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


def _breaks(text: str, start: int, end: int, skip: int, small: bool, whole: Callable[[], tuple[str, ...]], stated: str | None) -> list[int]:
    """Places in [start, end) after which a new sentence starts."""
    *_, marks, _ = _compiled()
    body = text[start:end]
    rules = _cascade(languages(body, whole, stated), small)
    # with the place after which nothing but space comes before the closing mark
    inside = [(a, b, a + len(body[a : b - 1].rstrip())) for a, b in spans(body, skip)]
    last = len(body.rstrip())
    out, k, at = [], 0, skip
    while m := marks.search(body, at):
        a, p = m.span()
        at = p
        while k < len(inside) and inside[k][1] <= a:
            k += 1
        if k < len(inside) and inside[k][0] < a:  # within a quotation
            close = inside[k][1]
            if p < inside[k][2] or body[inside[k][0]] == "`":
                at = max(p, close) if body[inside[k][0]] == "`" else p
                continue
            p = at = close
            k += 1
        if p >= last:
            break
        for stop, rule in rules:
            if rule.match(body, p):
                if stop:
                    out.append(start + p)
                break
    return out


def units(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence unit, in code points, end exclusive."""
    if not text or not text.strip():
        return []
    capital, found = _compiled()[3], blocks(text)
    told: list[tuple[str, ...]] = []  # asked for only where a block doesn't tell

    def whole() -> tuple[str, ...]:
        if not told:
            told.append(_leading(_told(text)))
        return told[0]

    stated = (lang or "").strip()[:2].lower()
    out = []
    for s, e, skip in found:
        small = skip >= 0 and not capital.search(text, s, e)
        cuts = [s, *(_breaks(text, s, e, skip, small, whole, stated) if skip >= 0 else []), e]
        for a, b in zip(cuts, cuts[1:], strict=False):
            unit = text[a:b]
            left = len(unit) - len(unit.lstrip())
            if left < len(unit):
                out.append((a + left, a + len(unit.rstrip())))
    return out


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, sent_start, sent_end) of every unit of every text; no shuffle. The
    column ``lang`` need not be there."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("sent_start", T.IntegerType()), T.StructField("sent_end", T.IntegerType())])

    def split(batches: Iterator) -> Iterator:
        import pyarrow as pa

        arrow = to_arrow_schema(schema)
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, t, stated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for a, b in units(t, stated):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], schema=arrow)

    stated = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    return docs.select(key, text, stated.alias("stated")).mapInArrow(split, schema)
