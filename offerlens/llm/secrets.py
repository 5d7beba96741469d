"""Secret scans: fixed patterns, and guess-cost of values that stand in a credential context.

Base spans come from three patterns. The method adds spans of kind `guess`: the value after a
credential word (password, pwd, passphrase, secret, token, key, bearer ...) is cut at white space
or its quote, and the cheapest way to guess it is found by dynamic programming over its
segmentations into known words, dates, repeats, keyboard walks and brute-force spans. A value that
costs at least MIN_GUESSES guesses is a secret. A value that base spans cover whole adds nothing; one that
they cover in part is scored whole, and its span stands beside theirs.

Costs (log10 of guesses) add up along a segmentation, and every part after the first but separators adds
PART for its kind. Word: its rank, doubled for capitals, more for digit-for-letter swaps; ranks are those of WORDS
and, where a tokenizer's file is given, of the whole words of its vocabulary in the order of its merges (some
32,000), whichever is less. A run of letters in one case that the list lacks may be a word of some language: UNKNOWN_WORD,
and 1 for each letter after the 16th. Date: 365 times the years from a reference year, at least 20. Repeat: the
unit's cost times the count, for all of its units or up to three less. Walk (of neighbouring keys, or of code points): start keys times turns and length, doubled for each capital among small letters.
Separator: SEPARATOR for one of `-_./`. Brute force: 10 for each character.
In prose (`the password is ...`, without quotes) letters and separators alone need PROSE more.

Values have any length and any number of parts: the program walks the value from its start, through those
places alone that less than the bound reaches; where none is left, the value is proven to cost the bound.

Defined cases: a null text is empty and has no spans; kinds are scanned on their own, leftmost and
without overlap; repeated rows are scanned one by one; extra columns are ignored, whatever their names (redact keeps them); whole texts of
any length are scanned; an empty table gives no rows. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A run that is long enough is matched from its start, so a bound in the pattern finds what dropping short matches leaves.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|(?:api|access|private|secret|auth)[_ -]?key)["']?(\x20*(?::=|=>|->|[:=])\x20*|\x20+is:?\x20+|(?<=bearer)\x20+)(?:"([^"\n]{6,})"|'([^'\n]{6,})'|([^\s"'<>]{6,}))""",
    re.I | re.A,
)
_PLAIN = re.compile(r"[^\W\d_]+(?:[-'/.][^\W\d_]+)*")
#: A text without any of these has no assignment and no credential context.
_HINTS = ("pass", "pwd", "secret", "token", "credential", "bearer", "key")

MIN_GUESSES = 10.0
PROSE = 3.0
PART = 0.5
SEPARATOR = 0.5
#: The vocabulary whose whole words are known words, by its name among the public tokenizers.
VOCABULARY = "word_bpe_49k.json"

#: Words that people put into passwords, commonest first: fixed values.
WORDS = (
    "password qwerty abc letmein welcome admin login master hello dragon monkey iloveyou sunshine princess football baseball shadow superman batman trustno starwars "
    "secret pass test guest root user default changeme temp demo example sample summer winter spring autumn monday friday love money freedom whatever ninja mustang "
    "access flower cheese computer internet server database network system service company office manager world house happy lucky orange banana purple yellow silver "
    "golden black white green blue red star moon sun fire water dog cat bird tiger lion bear eagle horse the and you for not with this that one two three four five "
    "token key none null true false your here insert required value string change forgot reset strength policy manager protected"
).split()
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_SWAPS = str.maketrans("4@301!5$7", "aaeoiisst")
_YEARS, _SEP = "(?:19|20)[0-9][0-9]", "[-/.]?"
#: Day, month and year or the year first, days and months of one or two digits; or a year alone.
_DATES = [re.compile(_YEARS)] + [
    re.compile(form.format(f"[0-9]{{{a}}}", f"[0-9]{{{b}}}")) for a in (1, 2) for b in (1, 2) for form in ("{}" + _SEP + "{}" + _SEP + _YEARS.replace("{", "{{"), _YEARS + _SEP + "{}" + _SEP + "{}")
]
_LETTERS = re.compile(r"[^\W\d_]+")
#: log10 of the guesses for a word that the list lacks.
UNKNOWN_WORD = 5.0
REFERENCE_YEAR = 2020


#: The mean log10 probability of a pair of letters from which a run of them reads like a word.
READS = -1.5
_LETTERS_KNOWN = 26


class Words:
    """Ranks of known words, the length of the longest, and how likely their letters follow one another.

    Each pair counts half a time more than it is seen.
    """

    def __init__(self, ranks: dict[str, int], modelled: bool = False):
        self.ranks, self.longest, self.modelled = ranks, max(map(len, ranks), default=0), modelled
        pairs: Counter[str] = Counter()
        for word in ranks if modelled else ():
            marked = f"^{word}$"
            pairs.update(map("".join, zip(marked, marked[1:])))
        total: Counter[str] = Counter()
        for pair, n in pairs.items():
            total[pair[0]] += n
        self.pairs = {pair: math.log10((n + 0.5) / (total[pair[0]] + 0.5 * (_LETTERS_KNOWN + 1))) for pair, n in pairs.items()}
        self.unseen = {c: math.log10(0.5 / (n + 0.5 * (_LETTERS_KNOWN + 1))) for c, n in total.items()}

    def reads(self, run: str) -> bool:
        """Whether a run of letters reads like a word."""
        if not self.modelled or not run.isascii():
            return True
        marked = f"^{run.lower()}$"
        return sum(self.pairs.get(a + b) or self.unseen.get(a, -1.5) for a, b in zip(marked, marked[1:])) >= READS * (len(marked) - 1)


@lru_cache(4)
def known_words(path: str | None = None) -> Words:
    """WORDS, and the whole words of three letters or more in a tokenizer's vocabulary, in the order of its ids."""
    ranks = {w: i for i, w in enumerate(dict.fromkeys(WORDS), 1)}
    if path is not None:
        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        whole = (w.removesuffix("</w>") for w in sorted(ids, key=ids.get) if w.endswith("</w>") and len(w) >= 7)
        for i, w in enumerate((w for w in whole if w.isascii() and w.isalpha()), 1):
            ranks[w] = min(i, ranks.get(w, i))
    return Words(ranks, path is not None)


def parts_at(value: str, low: str, plain: str, i: int, words: Words) -> Iterator[tuple[int, float]]:
    """(end, log10 guesses) of every part of value but brute force and repeats that starts at i."""
    n, ranks = len(value), words.ranks
    for j in range(i + 3, min(n, i + words.longest) + 1):
        rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
        if rank:
            swaps = sum(a != b for a, b in zip(low[i:j], plain[i:j])) if low[i:j] not in ranks else 0
            upper = sum(c.isupper() for c in value[i:j])
            yield j, math.log10(rank * (2 if upper else 1) * 2**swaps)
    for form in _DATES if low[i].isdigit() else ():
        if m := form.match(low, i):
            year = int(m[0][:4] if form.pattern.startswith(_YEARS) else m[0][-4:])
            yield m.end(), math.log10(max(abs(year - REFERENCE_YEAR), 20) * (365 if m.end() - i > 4 else 1))
    # a run of letters in one case may be a word of some language
    if not (i and _LETTERS.match(value, i - 1)) and (m := _LETTERS.match(value, i)) and m.end() - i >= 3 and (m[0].islower() or m[0].isupper() or m[0].istitle()):
        size = m.end() - i
        if size <= UNKNOWN_WORD or words.reads(m[0]):
            yield m.end(), min(float(size), UNKNOWN_WORD) + max(0, size - 16)
    if i and value[i] in "-_./":
        yield i + 1, SEPARATOR - PART
    for step in ("key", 1, -1):  # walks of three neighbouring keys and more, and runs of code points such as abcd or 4321; they may end anywhere
        j, turns, last = i + 1, 1, None
        uppers, lowers = value[i].isupper(), value[i].islower()
        while j < n:
            if step == "key":
                a, b = _PLACE.get(low[j - 1]), _PLACE.get(low[j])
                move = (b[0] - a[0], b[1] - a[1]) if a and b else None
                if move is None or move == (0, 0) or max(map(abs, move)) > 1:
                    break
                turns, last = turns + (last not in (None, move)), move
            elif ord(low[j]) - ord(low[j - 1]) != step:
                break
            uppers, lowers = uppers + value[j].isupper(), lowers + value[j].islower()
            j += 1
            if j - i >= 3:
                case = math.log10(2) * uppers if lowers else 0.0
                yield j, case + (math.log10(47 * (j - i)) + turns * math.log10(4) if step == "key" else math.log10(26 * (j - i)))


def _shared(value: str) -> list[int]:
    """For every place, the characters that value has in common with what starts there."""
    n = len(value)
    out, left, right = [0] * n, 0, 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and value[k] == value[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def _repeats_at(value: str, i: int) -> Iterator[tuple[int, int]]:
    """(unit, count) of the repeats that start at i, but for units that are repeats themselves."""
    n = len(value)
    covered: list[tuple[int, int]] = []  # (unit, how far it repeats)
    near = min(16, (n - i) // 2 + 1)
    seed = value[i : i + 16]
    found: list[tuple[int, int]] = []
    if value.find(seed, i + 16) >= 0 and n - i >= 32:
        found = [(u, z) for u, z in enumerate(_shared(value[i:])) if u and z >= u]
    else:
        for u in range(1, near):
            z = 0
            while value.startswith(value[i : i + u], i + u + z):
                z += u
            if z:
                found.append((u, z))
    for u, z in found:
        if not any(u % v == 0 and 2 * u <= far for v, far in covered):
            covered.append((u, u + z))
            yield u, 1 + z // u


def repeats_at(value: str, i: int, words: Words, bound: float) -> Iterator[tuple[int, float]]:
    """(end, log10 guesses) of every repeat that starts at i."""
    for unit, count in _repeats_at(value, i):
        cost = float(unit) if unit < 3 else min(float(unit), guess_cost(value[i : i + unit], words, bound))
        for c in range(max(2, count - 3), count + 1):
            if c * unit >= 3:
                yield i + c * unit, cost + math.log10(c)


def guess_cost(value: str, words: Words | None = None, bound: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes; infinity if that is proven to be bound or more.

    Places are visited in order. Of each, two costs are kept: of segmentations that end there with a
    brute-force span, which may grow, and of any.
    """
    words = known_words() if words is None else words
    low = value.lower()
    plain = low.translate(_SWAPS)
    any_, brute, places = {0: 0.0}, {}, [0]

    def reach(j: int, cost: float) -> None:
        if cost < bound:
            if j not in any_:
                heapq.heappush(places, j)
            any_[j] = min(cost, any_.get(j, math.inf))

    while places:
        i = heapq.heappop(places)
        if i == len(value):
            return any_[i]
        so_far = any_.pop(i) + (PART if i else 0.0)
        if (grown := min(brute.pop(i, math.inf), so_far) + 1.0) < bound:
            brute[i + 1] = grown
            reach(i + 1, grown)
        for j, cost in parts_at(value, low, plain, i, words):
            reach(j, so_far + cost)
        for j, cost in repeats_at(value, i, words, bound):
            reach(j, so_far + cost)
    return math.inf


def _union(spans: list[tuple[int, int, str]]) -> list[list[int]]:
    """The spans as sorted stretches [start, end] that neither overlap nor touch."""
    out: list[list[int]] = []
    for start, end, _ in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def scan(text: str, words: Words | None = None, min_guesses: float = MIN_GUESSES) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start and then in the order of KINDS."""
    low = text.lower()
    spans: list[tuple[int, int, str]] = []
    hinted = any(h in low for h in _HINTS)
    if hinted:
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if hinted:
        base = _union(spans)
        for m in _CONTEXT.finditer(text):
            start, end = next(m.span(k) for k in (2, 3, 4) if m[k] is not None)
            while end > start and text[end - 1] in ".,;:!?)]}":
                end -= 1
            at = bisect_right(base, start, key=lambda x: x[0]) - 1
            covered = at >= 0 and base[at][1] >= end
            if end - start < 6 or covered:
                continue
            value = text[start:end]
            prose = m[4] is not None and m[1].strip().lower().startswith("is") and _PLAIN.fullmatch(value)
            if guess_cost(value, words, min_guesses + (PROSE if prose else 0.0)) == math.inf:
                spans.append((start, end, "guess"))
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) per row of docs; vocabulary: the file that known_words reads."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_words(vocabulary)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = scan(text.as_py() or "", words)
                base = [x for x in spans if x[2] != "guess"]
                n = [sum(x[2] == k for x in spans) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact_text(text: str, words: Words | None = None, mark: str = "[SECRET]") -> str:
    """text with every union of overlapping spans replaced by mark."""
    out, at = [], 0
    spans = scan(text, words)
    k = 0
    while k < len(spans):
        start, end, _ = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][1])
        out += [text[at:start], mark]
        at, k = end, k + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs with secrets cut out of their texts and n_chars (where there is one) counted anew; a null text stays null."""

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known_words(vocabulary)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [None if x is None else redact_text(x, words) for x in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if (n := batch.schema.get_field_index("n_chars")) >= 0 and pa.types.is_integer(batch.schema.field(n).type):
                counts = [None if old is None else (old if t is None else len(t)) for old, t in zip(columns[n].to_pylist(), texts)]
                columns[n] = pa.array(counts, batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    plain = docs.toDF(*[c if c in ("text", "n_chars") else f"c{i}" for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(masked, plain.schema).toDF(*docs.columns)
