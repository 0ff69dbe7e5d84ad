"""Personal data: fixed expressions, and a linear-chain conditional random field over word shapes.

The expressions (``BASE_KINDS``) are exact and always reported. The random field is trained in numpy on a small labelled
table of its own: sentences with marked spans, made by ``labelled_table`` from forms of values (addresses with their at sign spelt out,
national and international numbers, cards in any grouping) and of what only looks like them (dates, versions, prices, hashes), or any
table of the same kind with at most ``LABELLED_ROWS`` rows. It never sees the expressions, so it tags what they cannot: numbers
without country code, cards with a mistyped digit, values that stand side by side.

Tokens are runs of letters and digits, or single other characters; a shape says what a whole token consists of, however long. A
run is a stretch of tokens at most ``REACH`` tokens away from one with a digit, an at sign or the word for a dot; other tokens are
never tagged. Runs are decoded by Viterbi in numpy batches of bounded size, in windows of ``WINDOW`` tokens that overlap by ``OVERLAP`` tokens on
both sides (more than any value is long); only the middle of a window counts. So a text of nothing but numbers takes no more
memory than any other, and every text is searched whole.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apidrift.llm.tables import frugal, slices, small_batches, whole

Span = tuple[int, int, str]
Token = tuple[int, int, str]

BASE_KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{edge}-{kind}" for kind in BASE_KINDS for edge in "BI"))
#: Bound of the labelled table, and the size of the one made here.
LABELLED_ROWS, MADE_ROWS = 4_000, 800
REACH = 10
WINDOW, OVERLAP = 256, 32
#: Tokens (padded) that are decoded at a time, and bytes of text whose spans are held.
TOKENS_AT_ONCE, BLOCK_BYTES = 16_384, 2 << 20
FEATURES = 1 << 14
#: Least posterior of each token of a reported span.
SURE = 0.9

# Expressions of the contract. Lookbehinds keep a search from starting anew inside a run of digits.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_MARK = re.compile(r"[0-9@]|\bdot\b")
_DIGITS = str.maketrans("", "", " -")
#: Words that announce a value.
_CONTEXT = frozenset("call phone tel fax ring mobile mail email card visa ip host server at dot".split())


def _emails(text: str) -> Iterator[tuple[int, int]]:
    behind, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > behind and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
            behind = match.end()
        # What fails here cannot be part of a later match: an at sign ends every local part.
        behind = max(behind, at + 1)
        at = text.find("@", behind)


def _octet(part: str) -> bool:
    """At most 255, however many zeros come first."""
    rest = part.lstrip("0")
    return len(rest) <= 3 and int(rest or 0) <= 255


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind), by start and then in the order of ``BASE_KINDS``."""
    spans = [(a, b, "email") for a, b in _emails(text)]
    spans += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(_octet(p) for p in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].translate(_DIGITS)) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        spans += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], BASE_KINDS.index(s[2])))


def windows(text: str) -> Iterator[tuple[list[Token], int, int, bool]]:
    """Windows of tokens near a mark: tokens, the part that counts (from, to), and whether the window before is continued."""
    if not _MARK.search(text):
        return
    held: list[Token] = []
    before: list[Token] = []
    quiet, goes_on = 0, False
    for m in _TOKEN.finditer(text):
        token = (m.start(), m.end(), m[0])
        if _MARK.search(m[0]):
            held = held or before
            held.append(token)
            before, quiet = [], 0
        elif held and quiet < 2 * REACH:
            held.append(token)
            quiet += 1
        else:
            if held:
                held = held[:len(held) - quiet + REACH] if quiet > REACH else held
                yield held, OVERLAP if goes_on else 0, len(held), goes_on
                before, held, quiet, goes_on = [], [], 0, False
            before = [*before[1 - REACH:], token]
        if len(held) >= WINDOW:
            yield held, OVERLAP if goes_on else 0, len(held) - OVERLAP, goes_on
            held, goes_on = held[-2 * OVERLAP:], True
    if held:
        held = held[:len(held) - quiet + REACH] if quiet > REACH else held
        yield held, OVERLAP if goes_on else 0, len(held), goes_on


@lru_cache(1 << 14)
def shape(token: str) -> str:
    """What a token consists of: digits by number, letters by case and length class, mixtures, or the character itself."""
    if token.isdecimal():
        return f"d{min(len(token), 24)}"
    if token.isalpha():
        case = "x" if token.islower() else "X" if token.isupper() else "Xx" if token[0].isupper() and token[1:].islower() else "xX"
        return case + str(min(len(token), 64).bit_length())
    if len(token) == 1:
        return token
    return "h" if not token.lower().strip("0123456789abcdef") else f"m{min(len(token), 64).bit_length()}"


def features(run: list[Token]) -> list[list[int]]:
    """Hashed indicators of each token: shapes of itself and its neighbours, gaps, digits of the stretch without gaps around it."""
    n = len(run)
    shapes = [shape(token) for *_, token in run]
    lowered = [t.lower() if len(t) <= 8 else "" for *_, t in run]
    gap = [i == 0 or run[i - 1][1] != run[i][0] for i in range(n)] + [True]
    stretch = [""] * n
    i = 0
    while i < n:
        j = i + 1
        while j < n and not gap[j]:
            j += 1
        digits = [len(t) for *_, t in run[i:j] if t.isdecimal()]
        name = f"{min(sum(digits), 24)}:{min(len(digits), 6)}:{'a' if any(t.isalpha() for *_, t in run[i:j]) else ''}{'@' if any(t == '@' for *_, t in run[i:j]) else ''}"
        stretch[i:j] = [name] * (j - i)
        i = j
    edge = "|"
    at = lambda k: (" " if gap[k] else "") + shapes[k] if 0 <= k < n else edge
    word = lambda k: lowered[k] if 0 <= k < n and lowered[k] in _CONTEXT else ""
    after = lambda k: stretch[k] if 0 <= k < n else edge
    # Which of the signs of an address stand within eight tokens on either side.
    sign = [t if t in ("@", "at", "dot") else "" for t in lowered]
    near = lambda part: "".join(sorted(set(part)))
    out = []
    for i in range(n):
        a, b, c, d, e = at(i - 2), at(i - 1), at(i), at(i + 1), at(i + 2)
        octet = "o" if shapes[i] in ("d1", "d2", "d3") and int(run[i][2]) <= 255 else "n"
        named = (
            "bias", f"s{c}", f"p{b}", f"q{d}", f"P{a}{b}", f"Q{d}{e}", f"r{b}{c}", f"t{c}{d}", f"u{b}{c}{d}", f"U{a}{b}{c}", f"V{c}{d}{e}",
            f"g{gap[i + 1]}{c}", f"c{stretch[i]}", f"C{stretch[i]}{c}{octet}", f"l{after(i - 1)}~{c}" if gap[i] else f"l{after(i - 2)}",
            f"d{near(sign[max(0, i - 8):i])}>{shapes[i][0]}", f"D{near(sign[i + 1:i + 9])}<{shapes[i][0]}{gap[i]}", f"w{word(i)}", f"x{word(i - 1)}{word(i - 2)}", f"y{word(i - 3)}{word(i + 1)}{word(i + 2)}",
        )
        out.append([zlib.crc32(f.encode()) % FEATURES for f in named])
    return out


def tags(run: list[Token], spans: list[Span]) -> list[int]:
    """The tag of each token, from the first span that overlaps it."""
    out, previous = [], None
    for start, end, _ in run:
        hit = next((s for s in spans if s[0] < end and start < s[1]), None)
        out.append(TAGS.index(f"{'I' if hit is previous else 'B'}-{hit[2]}") if hit else 0)
        previous = hit
    return out


def labelled_table(rows: int = MADE_ROWS, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Sentences of made-up words with marked values and look-alikes; the same arguments give the same table."""
    rnd = random.Random(seed)
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    syllables = ["an", "ber", "ció", "den", "eau", "für", "ing", "ka", "lo", "ment", "ne", "os", "que", "ra", "ß", "the", "ti", "un", "wh", "é"]
    name = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    plain = lambda: "".join(rnd.choice("abcdehilmnorstu") for _ in range(rnd.randrange(2, 9)))
    octets = lambda: ".".join(str(rnd.randrange(256)) for _ in range(4))
    sep = lambda: rnd.choice([" ", "-", ".", ""])

    def email() -> str:
        user = rnd.choice([plain(), f"{plain()}.{plain()}", plain() + d(2), f"{plain()}_{plain()}", d(2)])
        host = f"{rnd.choice([plain(), 'mail' + d(1), 'example'])}{rnd.choice(['', '.' + plain()])}"
        end = rnd.choice(["com", "org", "net", "de", "fr"])
        return rnd.choice([f"{user}@{host}.{end}", f"{user} at {host.replace('.', ' dot ')} dot {end}", f"{user} [at] {host} [dot] {end}",
                           f"{user}(at){host} dot {end}"])

    def card() -> str:
        s = sep()
        return rnd.choice([s.join(d(4) for _ in range(4)), s.join([d(4), d(6), d(5)]), d(16), d(16)])

    def phone() -> str:
        s = rnd.choice(["-", " ", "."])
        return rnd.choice([
            f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(7)}", f"+{d(2)}{s}{d(3)}{s}{d(7)}", f"({d(3)}) {d(3)}{s}{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}",
            f"0{d(3)} {d(7)}", f"0{d(3)}/{d(6)}", f"00{d(2)} {d(3)} {d(6)}"])

    def noise() -> str:
        year = f"{rnd.choice(['19', '20'])}{d(2)}"
        return rnd.choice([
            year, f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}.{d(2)}.{year}", f"{d(2)}:{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.", f"v{d(1)}.{d(1)}.{d(2)}",
            f"{d(1)}.{d(2)}.{d(1)}", f"{d(3)},{d(3)}", f"${d(3)}.{d(2)}", f"{d(2)}%", f"#{d(5)}", d(rnd.choice([1, 2, 3, 5, 6, 8, 12])), f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}",
            d(rnd.choice([22, 30])), "".join(rnd.choice("0123456789abcdef") for _ in range(40)), f"{rnd.randrange(256, 999)}.{d(3)}.{d(3)}.{d(3)}", f"@{plain()}", f"{plain()} @ {d(2)}", f"{d(2)} x {d(3)}", f"({d(3)})",
            f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", f"{plain()} at {plain()}", f"connect the dot {plain()}", f"the dot at {plain()}"])

    forms = {"email": email, "ip": octets, "card": card, "phone": phone}
    announced = {"email": ["mail", "email"], "ip": ["ip", "host", "server"], "card": ["card", "visa"], "phone": ["call", "tel", "phone", "fax", "ring", "mobile"]}
    out = []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rnd.randrange(1, 4)):
            text += " ".join(rnd.choice([name, name, plain])() + rnd.choice(["", "", "", ",", ".", " |", "!!"]) for _ in range(rnd.randrange(0, 8)))
            text += rnd.choice([" ", " ", "\n", ": ", " (", '"', ""]) if text else ""
            if text and text[-1].isalnum():
                text += " "
            for _ in range(rnd.choice([1, 1, 1, 2, 3])):  # values side by side, too
                kind = rnd.choice([*BASE_KINDS, None, None])
                if kind and rnd.random() < 0.3:
                    text += rnd.choice(announced[kind]) + rnd.choice([" ", ": "])
                value = forms[kind]() if kind else noise()
                if rnd.random() < 0.1:
                    value = value.upper()
                if kind:
                    spans.append((len(text), len(text) + len(value), kind))
                text += value + rnd.choice([" ", " ", " ", ", ", ". ", "\n", ") ", "!! ", "| "])
        out.append((text + name(), spans))
    return out


class ChainField:
    """Linear-chain conditional random field with hashed indicator features."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    @staticmethod
    def _padded(rows: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, rows))
        ids = np.zeros((len(rows), longest, len(rows[0][0])), np.int32)
        mask = np.zeros((len(rows), longest), bool)
        for i, row in enumerate(rows):
            ids[i, :len(row)] = row
            mask[i, :len(row)] = True
        return ids, mask

    def _scores(self, ids: np.ndarray) -> np.ndarray:
        return sum(self.emit[ids[..., f]] for f in range(ids.shape[2]))

    def _marginals(self, scores: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward: log alpha, log beta, log normaliser."""
        n, longest, k = scores.shape
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + self.move, axis=1) + scores[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(self.move + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, beta[:, t + 1])
        return alpha, beta, np.logaddexp.reduce(alpha[:, -1], axis=1)

    @classmethod
    def train(cls, rows: list[list[list[int]]], golds: list[list[int]], epochs: int = 40, rate: float = 0.2, ridge: float = 1e-4) -> ChainField:
        """Adam on the mean conditional log-likelihood; the same rows give the same model."""
        classes: dict[int, list[int]] = defaultdict(list)
        for i, row in enumerate(rows):
            classes[len(row).bit_length()].append(i)
        k = len(TAGS)
        new = cls(np.zeros((FEATURES, k)), np.zeros((k, k)))
        parts, moved = [], np.zeros((k, k))
        for members in classes.values():
            ids, mask = cls._padded([rows[i] for i in members])
            gold = np.zeros(mask.shape, np.int64)
            for j, i in enumerate(members):
                gold[j, :len(golds[i])] = golds[i]
            pair = mask[:, 1:]
            np.add.at(moved, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)
            parts.append((ids, mask, np.eye(k)[gold] * mask[..., None], pair, ids[mask].ravel()))
        slopes = [np.zeros_like(new.emit), np.zeros_like(new.move)]
        sizes = [np.zeros_like(new.emit), np.zeros_like(new.move)]
        for epoch in range(1, epochs + 1):
            emit, expected = np.zeros_like(new.emit), np.zeros_like(new.move)
            for ids, mask, one, pair, at in parts:
                scores = new._scores(ids)
                alpha, beta, total = new._marginals(scores, mask)
                single = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
                expected += (np.exp(
                    alpha[:, :-1, :, None] + new.move + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None],
                ) * pair[..., None, None]).sum(axis=(0, 1))
                wrong = (one - single)[mask]
                emit += np.stack([np.bincount(at, np.repeat(wrong[:, t], ids.shape[2]), FEATURES) for t in range(k)], axis=1)
            for i, (weight, slope) in enumerate(zip((new.emit, new.move), (emit, moved - expected), strict=True)):
                slope = slope / len(rows) - ridge * weight
                slopes[i] = 0.9 * slopes[i] + 0.1 * slope
                sizes[i] = 0.99 * sizes[i] + 0.01 * slope ** 2
                weight += rate * (slopes[i] / (1 - 0.9 ** epoch)) / (np.sqrt(sizes[i] / (1 - 0.99 ** epoch)) + 1e-8)
        return new

    def decode(self, rows: list[list[list[int]]]) -> list[tuple[list[int], list[float]]]:
        """Viterbi tags of each row with their posteriors; rows of one length class share a batch of bounded size."""
        out: list = [None] * len(rows)
        classes: dict[int, list[int]] = defaultdict(list)
        for i, row in enumerate(rows):
            classes[len(row).bit_length()].append(i)
        for members in classes.values():
            most = max(1, TOKENS_AT_ONCE // max(len(rows[i]) for i in members))
            for at in range(0, len(members), most):
                chunk = members[at:at + most]
                ids, mask = self._padded([rows[i] for i in chunk])
                scores = self._scores(ids)
                n, longest, k = scores.shape
                best, back = scores[:, 0], np.zeros((n, longest, k), np.int8)
                for t in range(1, longest):
                    paths = best[:, :, None] + self.move
                    back[:, t] = np.where(mask[:, t, None], paths.argmax(axis=1), np.arange(k))
                    best = np.where(mask[:, t, None], paths.max(axis=1) + scores[:, t], best)
                path = np.zeros((n, longest), np.int64)
                path[:, -1] = best.argmax(axis=1)
                for t in range(longest - 1, 0, -1):
                    path[:, t - 1] = back[np.arange(n), t, path[:, t]]
                alpha, beta, total = self._marginals(scores, mask)
                sure = np.exp(np.take_along_axis(alpha + beta - total[:, None, None], path[..., None], 2)[..., 0])
                for i, row, p in zip(chunk, path.tolist(), sure.tolist(), strict=True):
                    out[i] = (row[:len(rows[i])], p[:len(rows[i])])
        return out


@lru_cache(1)
def own_model() -> ChainField:
    """The field fitted to the labelled table made here, once a process."""
    return train(labelled_table())


def train(labelled: Iterable[tuple[str, list[Span]]]) -> ChainField | None:
    """A field fitted to labelled texts; None if nothing in them is personal."""
    rows, golds = [], []
    for text, spans in labelled:
        for run, first, last, _ in windows(text):
            rows.append(features(run[first:last]))
            golds.append(tags(run[first:last], spans))
    return ChainField.train(rows, golds) if any(map(any, golds)) else None


class _Finder:
    """Spans of texts, one after the other: windows wait until a batch is full."""

    def __init__(self, model: ChainField | None) -> None:
        self.model = model
        self.waiting: list[tuple[int, list[Token], int, int, bool]] = []
        self.size = 0
        self.found: dict[int, list[Span]] = defaultdict(list)
        #: The span that a window leaves open at its end: text, start, end, kind, sure.
        self.open: tuple[int, int, int, str, float] | None = None

    def read(self, key: int, text: str) -> None:
        for run, first, last, goes_on in windows(text):
            self.waiting.append((key, run, first, last, goes_on))
            self.size += len(run)
            if self.size >= TOKENS_AT_ONCE:
                self.flush()

    def flush(self) -> None:
        decoded = self.model.decode([features(run) for _, run, *_ in self.waiting]) if self.waiting else []
        for (key, run, first, last, goes_on), (path, sure) in zip(self.waiting, decoded, strict=True):
            if not goes_on:
                self._close()
            for (start, end, _), tag, p in zip(run[first:last], path[first:last], sure[first:last], strict=True):
                name = TAGS[tag]
                if self.open and name == f"I-{self.open[3]}":
                    self.open = (*self.open[:2], end, self.open[3], min(self.open[4], p))
                else:
                    self._close()
                    if tag:
                        self.open = (key, start, end, name[2:], p)
        self.waiting, self.size = [], 0

    def _close(self) -> None:
        if self.open and self.open[4] >= SURE:
            key, start, end, kind, _ = self.open
            self.found[key].append((start, end, kind))
        self.open = None

    def finish(self) -> dict[int, list[Span]]:
        self.flush()
        self._close()
        return self.found


def field_spans(texts: list[str], model: ChainField | None) -> dict[int, list[Span]]:
    """What the field finds in each text, by its place in the list."""
    finder = _Finder(model)
    if model:
        for key, text in enumerate(texts):
            finder.read(key, text)
    return finder.finish()


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_model, n_spans.

    Counts and digest are of the fixed expressions; ``spans`` also has what the random field adds where it overlaps
    none of those (``n_model`` of them). ``labelled`` is a table (text, spans: array of start, end, kind) to learn from, of which the ``LABELLED_ROWS``
    rows with the smallest hashes are taken; if it marks nothing there is no model. A null text is read as empty: no spans,
    the digest of the empty string. A value longer than ``OVERLAP`` tokens may be cut by the field, never by the expressions. Repeated rows each get
    a result; an empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    if labelled is None:
        model = own_model()
    else:
        taken = labelled.select("text", "spans").where("text is not null and spans is not null").orderBy(F.xxhash64("text"), "text").limit(LABELLED_ROWS)
        model = train([(r["text"], [tuple(x) for x in r["spans"]]) for r in taken.collect()])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in slices(whole_batch, "text", BLOCK_BYTES)):
            texts = batch.column("text").to_pylist()
            base = [base_spans(text) for text in texts]
            more = field_spans(texts, model)
            added = [_apart(more.get(i, []), b) for i, b in enumerate(base)]
            spans = [sorted(b + a, key=lambda s: (s[0], BASE_KINDS.index(s[2]))) for b, a in zip(base, added, strict=True)]
            count = lambda name: pa.array([sum(s[2] == name for s in b) for b in base], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), *map(count, BASE_KINDS),
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base], pa.string()),
                pa.array([joined(s) for s in spans], pa.string()), pa.array([len(a) for a in added], pa.int64()),
                pa.array([len(s) for s in spans], pa.int64()),
            ], names=["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_model", "n_spans"])

    return docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(
        frugal(found),
        f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long, n_spans long",
    ).withColumnRenamed("id", id_col)


def _apart(more: list[Span], base: list[Span]) -> list[Span]:
    """Spans that overlap none of the others; both come by start."""
    out, at, reach = [], 0, -1
    for span in more:
        while at < len(base) and base[at][0] < span[1]:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= span[0]:
            out.append(span)
    return out
