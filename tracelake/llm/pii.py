"""Operator 1: personal data, in plain form and disguised, with offsets into the source text.

Plain identifiers are found by four patterns (``base_spans``). For disguises, a chain of transducers
rewrites the text and keeps for every character the source range it came from: look-alike and
full-width characters become ASCII and invisible ones vanish; runs of spelled digits become digits;
``at`` and ``dot`` in brackets or words become signs. The same patterns are applied to the rewritten
text and their spans mapped back. A mapped span is added unless a plain span of its kind covers it.

A text without anything that a transducer changes is left after the plain patterns.

Rows: null text is empty and has no spans. Repeated rows are searched alike. An empty table gives no
rows. Only id and text are read.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow, slices, strings

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Characters that look like ASCII ones and aren't compatible forms of them.
_ALIKE = (
    dict(zip("авекмнорстухАВЕЅКМНОРСТУХЗ", "abekmhopctyxABESKMHOPCTYX3", strict=True))
    | dict(zip("іјѕһԁԛԝӏІЈҺԚԜ", "ijshdqwlIJHQW", strict=True))
    | dict(zip("αικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aiknoptuxABEZHIKMNOPTYX", strict=True))
    | dict(zip("ıɑɡɩօսʏᴀᴄᴇᴏꓸ․∙⋅‐‑‒–−", "iagiouyaceo....-----", strict=True))
)
_INVISIBLE = "­​‌‍⁠﻿"
# Digits in words, in the languages of the corpus.
_SPELLED = {
    w: d
    for d, names in enumerate(("zero null zéro cero", "one eins un uno", "two zwei deux dos", "three drei trois tres", "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete", "eight acht huit ocho", "nine neun neuf nueve"))
    for w in names.split()
}
_DOT_WORDS = "dot|punkt|punto|point"
_AT_WORDS = "at|arroba|arobase|chiocciola|ät"


def _compatible() -> dict[str, str]:
    """Characters whose compatibility form is one ASCII character: full-width, mathematical and circled forms."""
    found = {}
    for c in (*range(0x100, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F16A)):
        form = unicodedata.normalize("NFKC", chr(c))
        if len(form) == 1 and form.isascii() and form.isprintable() and form != " ":
            found[chr(c)] = form
        elif (d := unicodedata.digit(chr(c), None)) is not None:
            found[chr(c)] = str(d)
    return found


_CHARS = _compatible() | _ALIKE | dict.fromkeys(_INVISIBLE, "")
_BEYOND_LATIN = re.compile("[^\x00-\xac\xae-\xff]")  # besides the soft hyphen, all of _CHARS are beyond Latin-1
_WORD = "(?:" + "|".join(sorted(_SPELLED, key=len, reverse=True)) + ")"
_GAP = r"[ \t,;-]{1,3}"
_RUN = re.compile(rf"(?<![^\W_])(?:plus{_GAP})?{_WORD}(?:{_GAP}(?:(?:{_DOT_WORDS}){_GAP})?{_WORD})+(?![^\W_])", re.I)
_RUN_PART = re.compile(rf"(plus)|({_DOT_WORDS})|({_WORD})", re.I)
# Runs of white space are possessive and follow a character that isn't white space, so each is read a few times at most.
_OPEN, _CLOSE = r"[ \t]*+[\[({<][ \t]*+", r"[ \t]*+[\])}>][ \t]*+"
_AT = re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:{_OPEN}(?:{_AT_WORDS}|@){_CLOSE}|[ \t]++(?:{_AT_WORDS})[ \t]++|[ \t]++@[ \t]*+|@[ \t]++)|(?<=[A-Za-z0-9.%+-])_{{1,2}}(?:{_AT_WORDS})_{{1,2}}", re.I)
_DOT_SIGN = rf"{_OPEN}(?:{_DOT_WORDS}|\.){_CLOSE}|[ \t]++(?:{_DOT_WORDS})[ \t]++|_{{1,2}}(?:{_DOT_WORDS})_{{1,2}}"
_DOT = rf"(?:{_DOT_SIGN}|[ \t]?\.[ \t]?(?=[A-Za-z0-9]))"
_DOMAIN_IN_WORDS = re.compile(rf"[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+", re.I)
_DOT_IN_WORDS = re.compile(_DOT, re.I)
_DISGUISED_DOT = re.compile(_DOT_SIGN, re.I)
_IP_IN_WORDS = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_QUAD_IN_WORDS = re.compile(rf"(?<![\w.])(?:(?:[0-9]{{1,3}}|{_WORD})\.){{3}}(?:[0-9]{{1,3}}|{_WORD})(?!\w)", re.I)
_ONE_WORD = re.compile(_WORD, re.I)
# Words that say that an address follows.
_ANNOUNCE = re.compile(r"\b(?:e-?mails?|mail|contact|write(?: to)?|reach (?:me|us)|address|schreiben?|kontakt|correo|contacto|courriel|écrire)\b[\s:,]{0,3}\Z", re.I)
_PLAIN_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])")
# What a text must hold for the slower patterns above to match: asked of its words, which is quick.
_SPACES = bytes(i if i >= 0x80 or chr(i).isalnum() else 0x20 for i in range(256))
_ODD_MARKS = re.compile("[\xa0-\xbf\u2000-\u206f\u3000-\u303f]")
_SPELLED_BYTES = frozenset(w.encode() for w in _SPELLED)
_DOT_BYTES = frozenset(w.encode() for w in _DOT_WORDS.split("|"))
_AT_BYTES = frozenset(w.encode() for w in _AT_WORDS.split("|"))
_BRACKET = re.compile(r"[\[({<]")
_LOOSE_AT = re.compile(r"[ \t]@|@[ \t]")


def _hints(text: str) -> tuple[bool, bool, bool]:
    """Whether there can be a run of spelled digits, a disguised at, a disguised dot."""
    low = text.lower()
    if not low.isascii() and _ODD_MARKS.search(low):
        low = _ODD_MARKS.sub(" ", low)
    words = low.encode().translate(_SPACES).split()
    at = [i for i, w in enumerate(words) if w in _SPELLED_BYTES]
    run = any(b - a <= 2 for a, b in zip(at, at[1:], strict=False)) or any(w.isdigit() for i in at for w in (*words[max(0, i - 1) : i], *words[i + 1 : i + 2]))
    bracket = _BRACKET.search(text) is not None
    dot = bracket or not _DOT_BYTES.isdisjoint(words)
    sign = ("@" in text and (bracket or _LOOSE_AT.search(text) is not None)) or not _AT_BYTES.isdisjoint(words)
    return run, sign, dot


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (2 * d - 9 * (d > 4)) if k % 2 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of plain identifiers, by start and kind."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            start = at
            while start > done and _LOCAL.match(text[start - 1]):
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                out.append((start, m.end(), 0))
                done = m.end()
            at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        for m in _DOTTED.finditer(text):
            if (s := m.group()).count(".") >= 3:
                at, parts = m.start(), s.split(".")
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        out.append((at, end, 1))
                    at = end + 1
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((*m.span(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


class Mapped:
    """A text with the source range of every character."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, range(len(text)), range(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges (ascending, apart); a replacement's characters come from the whole range."""
        if not edits:
            return
        pieces, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            pieces += [self.text[at:a], new]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(new)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(new)]
            at = b
        self.text = "".join([*pieces, self.text[at:]])
        self.starts, self.ends = [*starts, *self.starts[at:]], [*ends, *self.ends[at:]]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def _digits(m: re.Match) -> str:
    """A run of spelled digits: digits side by side, dot words between them, a leading plus."""
    return "".join("+" if plus else "." if dot else str(_SPELLED[word.lower()]) for plus, dot, word in _RUN_PART.findall(m.group()))


def _dot_before(text: str, end: int, floor: int) -> int | None:
    """The start of a disguised dot that ends at ``end`` and follows a local part, if there is one."""

    def back(k: int, chars: str) -> int:
        while k > floor and text[k - 1] in chars:
            k -= 1
        return k

    k = back(end, " \t")
    bracket = k > floor and text[k - 1] in "])}>"
    if bracket:
        k = back(k - 1, " \t")
    word_end = k
    while k > floor and text[k - 1].isalpha():
        k -= 1
    if bracket and k == word_end and k > floor and text[k - 1] == ".":
        k -= 1
    if text[k:word_end].lower() not in {".", *_DOT_WORDS.split("|")}:
        return None
    start = back(k, " \t")
    if bracket:
        if start == floor or text[start - 1] not in "[({<":
            return None
        start = back(start - 1, " \t")
    elif start == k or word_end == end:
        return None
    return start if start > floor and _LOCAL.match(text[start - 1]) else None


def _signs(text: str) -> list[tuple[int, int, str]]:
    """Edits for at and dot disguises of whole addresses.

    An ``at`` in plain words counts beside a dot in disguise; beside plain dots only, where the local part
    isn't a plain word (letters with a digit, dot or underscore) or the words before announce an address.
    """
    edits: list[tuple[int, int, str]] = []
    done = 0
    for m in _AT.finditer(text):
        if m.start() < done or m.start() == 0 or not _LOCAL.match(text[m.start() - 1]):
            continue
        domain = _DOMAIN_IN_WORDS.match(text, m.end())
        if not domain:
            continue
        in_words = not re.search(r"[\[({<@]", m.group())
        start = m.start()
        if in_words and not _DISGUISED_DOT.search(domain.group()):
            domain = _PLAIN_DOMAIN.match(text, m.end())
            while start > done and _LOCAL.match(text[start - 1]):
                start -= 1
            local = text[start : m.start()].strip(".")
            if not domain or not (any(c.isalpha() for c in local) and any(c in "._" or c.isdigit() for c in local)) and not _ANNOUNCE.search(text, max(0, start - 24), start):
                continue
            edits.append((*m.span(), "@"))
            done = domain.end()
            continue
        dots = []
        while start > done:
            while start > done and _LOCAL.match(text[start - 1]):
                start -= 1
            if (sign := _dot_before(text, start, done)) is None:
                break
            dots.append((sign, start, "."))
            start = sign
        edits += [*reversed(dots), (*m.span(), "@")]
        edits += [(*d.span(), ".") for d in _DOT_IN_WORDS.finditer(text, domain.start(), domain.end())]
        done = domain.end()
    return edits


def disguised_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of identifiers that only the rewritten text shows."""
    odd = not text.isascii() and _BEYOND_LATIN.search(text) is not None and not _CHARS.keys().isdisjoint(set(text))
    mapped = Mapped(text)
    if odd:
        mapped.rewrite([(i, i + 1, _CHARS[c]) for i, c in enumerate(text) if c in _CHARS])
    can_run, can_sign, can_dot = _hints(mapped.text)
    runs = signs = dots = []
    if can_run:
        quads = [(*w.span(), str(_SPELLED[w.group().lower()])) for m in _QUAD_IN_WORDS.finditer(mapped.text) for w in _ONE_WORD.finditer(mapped.text, *m.span())]
        mapped.rewrite(quads)
        runs = [(*m.span(), _digits(m)) for m in _RUN.finditer(mapped.text)]
        mapped.rewrite(runs)
        runs += quads
    if can_sign:
        signs = _signs(mapped.text)
        mapped.rewrite(signs)
    if can_dot:
        dots = [(*d.span(), ".") for m in _IP_IN_WORDS.finditer(mapped.text) for d in _DOT_IN_WORDS.finditer(mapped.text, m.start(), m.end())]
        mapped.rewrite(dots)
    if not (odd or runs or signs or dots):
        return []
    starts: list[list[int]] = [[] for _ in KINDS]  # plain spans of a kind lie apart, so the last one that begins before is the only one that can cover
    ends: list[list[int]] = [[] for _ in KINDS]
    for a, b, kind in base:
        starts[kind].append(a)
        ends[kind].append(b)
    out = []
    for a, b, kind in base_spans(mapped.text):
        s, e = mapped.source(a, b)
        k = bisect_right(starts[kind], s) - 1
        if k < 0 or e > ends[kind][k]:
            out.append((s, e, kind))
    return out


def encode_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, base counts by kind, ``base`` and ``spans`` (arrays of kind, start, end)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch):
        out: dict[str, list] = {id_col: batch.column("id")} | {k: [] for k in (*(f"n_{k}" for k in KINDS), "base", "spans")}
        for text in strings(batch, "text"):
            base = base_spans(text)
            more = disguised_spans(text, base)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(x[2] == k for x in base) if base else 0)
            rows = [{"kind": KINDS[k], "start": a, "end": b} for a, b, k in base]
            out["base"].append(rows)
            out["spans"].append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in sorted([*base, *more], key=lambda x: (x[0], x[2]))] if more else rows)
        yield out

    span = "array<struct<kind:string,start:int,end:int>>"
    schema = f"`{id_col}` {id_type}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base {span}, spans {span}"
    return map_arrow(docs, {"id": F.col(id_col), "text": F.col(text_col).cast("string")}, schema, run)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span, plain or disguised, replaced by its kind in brackets; other columns as they are.

    Overlapping spans are replaced as one, by the first one's kind.
    """

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            k = batch.schema.get_field_index(text_col)
            texts = []
            for text in batch.column(k).to_pylist():
                base = base_spans(text or "")
                spans = sorted([*base, *disguised_spans(text or "", base)])
                at, parts = 0, []
                for a, b, kind in spans:
                    if a >= at:
                        parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
                    at = max(at, b)
                texts.append("".join([*parts, text[at:]]) if spans else text)
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, type=batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))

