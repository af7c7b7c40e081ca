"""Operator 13: secrets by pattern, and values beside credential words by what a guesser would pay for them.

Plain secrets are found by three patterns (``base_spans``): assignments, access keys and long hexadecimal
runs. Other values stand beside a credential word in forms that those patterns don't take: symbols in
the value, other words (``pwd``, ``passphrase``), other signs (``=>``, ``is``, mark-up, options, a login
in an address). Whether such a value is a secret or a placeholder, a name or prose is asked of a guesser:
a dynamic program cuts the value into the cheapest sequence of

- words, by their rank in a dictionary, with capitals and look-alike digits (``p4ssw0rd``);
- dates and years;
- repeats of a unit;
- walks over keyboard and alphabet;
- spans of single characters, tried by brute force over the kinds of characters in the value.

Costs are log10 of guesses, ``SWITCH`` more for every piece. A value of ``MIN_GUESSES`` and more is a
secret; one of letters only also has to cost nearly what brute force does (``LETTERS_RATIO``), as long
compounds are words in a row. Values with white space, references (``${NAME}``, ``<name>``), calls, paths,
addresses and dotted names aren't candidates. The dictionary is a public tokenizer's vocabulary, read by
path in the tasks: the order of its merges stands for the frequency of its words.

The program reads a value from left to right and stops where every way on costs more than asked for,
so its time doesn't grow with the length of a random value; all else is linear in the text.

Rows: null text is empty and has no spans. Repeated rows are searched alike. An empty table gives no
rows. Texts of any length are searched whole. Only id and text are read.
"""

from __future__ import annotations

import re
from functools import lru_cache
from math import comb, inf, log10

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.bpe import load_ranks
from tracelake.llm.common import hold, lowered, map_arrow, strings

KINDS = ("assign", "access", "hex")
#: log10 of the guesses from which a credential's value is a secret.
MIN_GUESSES = 9.0
#: log10 of the guesses that one more piece costs: which of five kinds it is.
SWITCH = log10(5)
#: Part of the brute-force cost that a value of letters only must reach.
LETTERS_RATIO = 0.8
#: Pieces have so many characters at most; repeats may have more, but units of so many at most.
LONGEST_WORD, LONGEST_WALK, LONGEST_UNIT = 24, 32, 16
YEARS = range(1900, 2060)

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

# Words beside which a credential stands, in the languages of the corpus.
_WORDS = r"password|passwd|passphrase|passcode|passwort|pwd|secret|token|credentials?|(?:api|access|private|encryption|signing)[_\x20-]?key|contraseña|mot\x20de\x20passe"
_SHORT = r"pass|auth|bearer|clave"
_KEY = re.compile(rf"(?:{_WORDS}|(?<![^\W_])(?:{_SHORT})(?![^\W_]))", re.I)
_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "contraseña", "auth", "bearer", "clave")
_SIGN = re.compile(r"""["']?[\x20\t]*(?:=>|:=|==|=|:|>)[\x20\t]*|[\x20\t]+(?:is|ist|es|est|lautet)[\x20\t]*:?[\x20\t]+""", re.I)
_OPTION = re.compile(r"[\x20\t]+")
_QUOTED = re.compile(r""""((?:\\.|[^"\\\n])*)"|'((?:\\.|[^'\\\n])*)'""")
_BARE = re.compile(r"""[^\s"'<>,;`]+""")
_LOGIN = re.compile(r"://[^\s:/@\"'<>]+:([^\s@/\"'<>]+)@")
_TAIL = ".:!?)]}"
_NO_SECRET = re.compile(r"[$%]?\{.*|\$[A-Za-z_(].*|%\w+%|<.*|[A-Za-z][A-Za-z0-9+.-]*://.*|(?:~|\.{1,2})?/.*|[^@]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|[A-Za-z_][\w.]*[\[(].*|[.:/_-]*(?:[A-Za-z]++[.:/_-]++)+[A-Za-z]*")

# Passwords that guessers try before any word.
_COMMON = "password passwort qwerty admin letmein welcome secret changeme default master monkey dragon login access passw0rd iloveyou sunshine princess football shadow test guest root user demo example sample placeholder required optional enabled disabled hidden redacted none null true false token string value your"
# Look-alikes of letters.
_LEET_SIGNS = "4@8(369!05$7+21|"
_LEET = tuple(str.maketrans(_LEET_SIGNS, "aabceggiossttz" + ends) for ends in ("il", "li"))
# A keyboard's rows, plain and shifted, and how far each is moved to the right.
_ROWS = (("`1234567890-=", "~!@#$%^&*()_+", 0.0), ("qwertyuiop[]\\", "QWERTYUIOP{}|", 1.5), ("asdfghjkl;'", 'ASDFGHJKL:"', 1.75), ("zxcvbnm,./", "ZXCVBNM<>?", 2.25))


def _keyboard() -> dict[tuple[str, str], tuple]:
    """The direction from each key to each of its neighbours, shifted or not."""
    keys = [(c, row, left + k) for row, (plain, shifted, left) in enumerate(_ROWS) for names in (plain, shifted) for k, c in enumerate(names)]
    found: dict[tuple[str, str], tuple] = {}
    for a, row_a, x in keys:
        for b, row_b, y in keys:
            if (row_a == row_b and abs(x - y) == 1) or (abs(row_a - row_b) == 1 and abs(x - y) < 1):
                found[a, b] = (row_b - row_a, y > x)
    return found


_NEIGHBOURS = _keyboard()
_N_KEYS, _N_TURNS = sum(len(plain) for plain, _, _ in _ROWS), 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of plain secrets, by start and kind."""
    return sorted(((a, b, k) for a, b, k, _ in _plain(text)), key=lambda x: (x[0], x[2]))


def _plain(text: str) -> list[tuple[int, int, int, tuple[int, int] | None]]:
    out = [(*m.span(), 0, m.span(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), 1, None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(*m.span(), 2, None) for m in _HEX.finditer(text)]


class Guesser:
    """What values cost to guess. ``words`` has ranks of words in lower case, from 1."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.unit_cost = lru_cache(100_000)(lambda unit: self.cost(unit, repeats=False))

    @classmethod
    def of_vocabulary(cls, path: str) -> Guesser:
        """Common passwords, then the vocabulary's words of three letters and more by rank."""
        words: dict[str, int] = {}
        for w in _COMMON.split():
            words.setdefault(w, len(words) + 1)
        for token in load_ranks(path):
            w = token.decode("utf-8", "ignore").strip().lower()
            if 3 <= len(w) <= LONGEST_WORD and w.isalpha():
                words.setdefault(w, len(words) + 1)
        return cls(words)

    def word(self, piece: str) -> float:
        """The cost of a piece that is a word in any case, some of its letters in disguise; infinite for other pieces."""
        best = inf
        low = lowered(piece)
        for plain in {low, low.translate(_LEET[0]), low.translate(_LEET[1])}:
            rank = self.words.get(plain)
            if rank:
                odd = sum(a != b for a, b in zip(low, plain, strict=True))
                best = min(best, log10(rank) + (1 + odd * log10(2) if odd else 0))
        if best < inf and low != piece:
            upper, lower = sum(map(str.isupper, piece)), sum(map(str.islower, piece))
            easy = upper == 1 and piece[0].isupper() or not lower
            best += log10(2) if easy else log10(sum(comb(upper + lower, k) for k in range(1, min(upper, lower) + 1)))
        return best

    def cost(self, value: str, limit: float = inf, repeats: bool = True) -> float:
        """log10 of the guesses of the cheapest way to cut ``value`` up; ``limit`` where every way costs that or more.

        A repeat takes all copies of its unit to its left.
        """
        n, one = len(value), log10(alphabet(value))
        best = [0.0] + [inf] * n  # by end
        brute = inf  # where the last piece is brute force
        begins = [0] * (LONGEST_UNIT + 1)  # by period, of the run that holds the last character
        walk = letters = 0  # where the walks over keys and over the alphabet begin that hold it
        turns = [0] * (n + 1)  # of the walk over keys, till an end
        way = along = None  # their last directions
        for end in range(1, n + 1):
            last = value[end - 1]
            least = brute = min(brute, best[end - 1] + SWITCH) + one
            for a in range(max(0, end - LONGEST_WORD), end - 2):
                if best[a] + SWITCH < least:
                    least = min(least, best[a] + SWITCH + self.word(value[a:end]))
            if "0" <= last <= "9":
                for a, c in dates(value, end):
                    least = min(least, best[a] + SWITCH + c)
            step = _NEIGHBOURS.get((value[end - 2], last)) if end > 1 else None
            turns[end] = turns[end - 1] + (None not in (step, way) and step != way)
            walk, way = (walk if step else end - 1), step
            for a in range(max(walk, end - LONGEST_WALK), end - 2):
                least = min(least, best[a] + SWITCH + walk_cost(end - a, turns[end] - turns[a + 2]))
            step = letter_step(value[end - 2], last) if end > 1 else None
            letters, along = (letters if step == along else end - 2) if step else end - 1, step
            for a in range(max(letters, end - LONGEST_WALK), end - 2):
                least = min(least, best[a] + SWITCH + walk_cost(end - a, 0))
            for p in range(1, min(LONGEST_UNIT, end - 1) + 1) if repeats else ():
                if value[end - 1 - p] != last:
                    begins[p] = end - p
                elif (k := (end - begins[p]) // p) >= 2:
                    least = min(least, best[end - k * p] + SWITCH + self.unit_cost(value[end - p : end]) + log10(k))
            best[end] = least
            if least >= limit and end < n:  # every other piece on the way begins in the longest one's reach, or is a repeat
                ahead = best[max(0, end - LONGEST_WALK) : end]
                ahead += [best[a] for p in range(1, LONGEST_UNIT + 1) for a in range(begins[p], min(begins[p] + p, end))] if repeats else []
                if min(ahead) >= limit:
                    return limit
        return min(best[n], limit)


def alphabet(value: str) -> int:
    """How many characters brute force tries in each place: those of the kinds in the value."""
    kinds = ((26, str.islower), (26, str.isupper), (10, str.isdigit))
    found = sum(n for n, has in kinds if any(c.isascii() and has(c) for c in value))
    found += 33 * any(c.isascii() and not c.isalnum() for c in value)
    return max(2, found + 100 * (not value.isascii()))


def walk_cost(length: int, turns: int) -> float:
    """A first key, a length and the directions of a walk over keys."""
    return log10(_N_KEYS) + log10(length) + (1 + turns) * log10(_N_TURNS)


def letter_step(a: str, b: str) -> int | None:
    """1 or -1 if ``b`` is the letter after or before ``a`` in the alphabet, in any case."""
    step = ord(b.lower()[0]) - ord(a.lower()[0])
    return step if (a + b).isascii() and (a + b).isalpha() and step in (1, -1) else None


_DATE = re.compile(r"([0-9]{4}|[0-9]{1,2})([-/._])([0-9]{1,2})\2([0-9]{4}|[0-9]{1,2})\Z")


def dates(value: str, end: int):
    """(start, cost) of the dates and years that end there."""
    days = log10(len(YEARS) * 366)
    if value[max(0, end - 4) : end].isdigit() and end >= 4 and int(value[end - 4 : end]) in YEARS:
        yield end - 4, log10(len(YEARS))
    for n in (6, 8):
        digits = value[max(0, end - n) : end]
        if len(digits) == n and digits.isascii() and digits.isdigit():
            cuts = ((4, 6), (2, 4)) if n == 8 else ((2, 4),)
            if any(_is_date(digits[:a], digits[a:b], digits[b:]) for a, b in cuts):
                yield end - n, days
    for n in range(6, 11):
        if end >= n and (m := _DATE.match(value[end - n : end])) and _is_date(m[1], m[3], m[4]):
            yield end - n, days + log10(4)


def _is_date(a: str, b: str, c: str) -> bool:
    """Whether three numbers are year, month and day in a usual order; years of two digits are any."""
    if len(a) == 4:
        return len(c) < 4 and int(a) in YEARS and 1 <= int(b) <= 12 and 1 <= int(c) <= 31
    if len(c) == 4 and int(c) not in YEARS:
        return False
    orders = [(int(a), int(b)), (int(b), int(a))] + ([(int(c), int(b))] if len(c) < 4 else [])
    return any(1 <= day <= 31 and 1 <= month <= 12 for day, month in orders)


def candidates(text: str):
    """(start, end, value's start, value's end) of values beside credential words and in addresses with a login."""
    low = text.lower()
    if any(h in low for h in _HINTS):
        at = 0
        while m := _KEY.search(text, at):
            at = m.end()
            sign = _SIGN.match(text, at)
            if sign is None and (text[max(0, m.start() - 2) : m.start()] == "--" or m.group().lower() == "bearer"):
                sign = _OPTION.match(text, at)
            if sign is None:
                continue
            if quoted := _QUOTED.match(text, sign.end()):
                start, end = quoted.span(quoted.lastindex)
            elif bare := _BARE.match(text, sign.end()):
                start, end = bare.span()
                while end > start and text[end - 1] in _TAIL:
                    end -= 1
            else:
                continue
            yield m.start(), end, start, end
    if "://" in text:
        for m in _LOGIN.finditer(text):
            yield *m.span(1), *m.span(1)


def is_secret(value: str, guesser: Guesser) -> bool:
    if len(value) < 4 or any(c.isspace() for c in value) or _NO_SECRET.fullmatch(value):
        return False
    least = MIN_GUESSES
    if value.isalpha():
        least = max(least, LETTERS_RATIO * len(value) * log10(alphabet(value)))
    return guesser.cost(value, least) >= least


def valued_spans(text: str, plain: list, guesser: Guesser) -> list[tuple[int, int, int, int]]:
    """(start, end, value's start, value's end) of secrets whose value no plain secret covers."""
    out: list[tuple[int, int, int, int]] = []
    ends: list[tuple[int, int]] = []  # plain spans whose end is a record, by start
    for a, b, *_ in sorted(plain):
        if not ends or b > ends[-1][1]:
            ends.append((a, b))
    k = 0
    done = 0
    for start, end, a, b in sorted(candidates(text), key=lambda x: x[2]):
        while k + 1 < len(ends) and ends[k + 1][0] <= a:
            k += 1
        covered = ends and ends[k][0] <= a and b <= ends[k][1]
        if a >= done and not covered and is_secret(text[a:b], guesser):
            out.append((start, end, a, b))
            done = b
    return out


def find(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, plain counts by kind, ``base`` and ``spans`` (kind, start, end), and ``found`` values (start, end)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch):
        guesser = hold(("guesser", vocabulary), lambda: Guesser.of_vocabulary(vocabulary))
        out: dict[str, list] = {id_col: batch.column("id")} | {k: [] for k in (*(f"n_{k}" for k in KINDS), "base", "spans", "found")}
        for text in strings(batch, "text"):
            plain = _plain(text)
            more = valued_spans(text, plain, guesser)
            base = sorted((a, k, b) for a, b, k, _ in plain)
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum(x[1] == k for x in base) if base else 0)
            out["base"].append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in base])
            out["spans"].append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted([*base, *((a, 0, b) for a, b, _, _ in more)])])
            out["found"].append([{"start": a, "end": b} for _, _, a, b in more])
        yield out

    span = "array<struct<kind:string,start:int,end:int>>"
    schema = f"`{id_col}` {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base {span}, spans {span}, found array<struct<start:int,end:int>>"
    return map_arrow(docs, {"id": F.col(id_col), "text": F.col(text_col).cast("string")}, schema, run)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns, and the number of values found by their cost."""
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(id_col, "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("found").cast("long").alias("n_guessed"))
