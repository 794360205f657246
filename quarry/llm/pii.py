"""Personal data: pattern matches, plus spans that a semi-Markov conditional random field adds."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import bounded_batches, sampled
from .decontam import merged

KINDS = ("email", "ip", "card", "phone")
#: The model knows one kind more: keys and tokens in assignments.
TYPES = (*KINDS, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
Span = tuple[str, int, int]


#: Twice a digit, its own digits added up.
_TWICE = bytes.maketrans(b"0123456789", b"0246813579")


def luhn(digits: str) -> bool:
    d = digits.encode()
    return (sum(d[-1::-2]) + sum(d[-2::-2].translate(_TWICE)) - 48 * len(d)) % 10 == 0


def _octets(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def _emails(text: str):
    """Leftmost matches in linear time: each starts at the run of local characters before an @."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the pattern matches by kind, then start."""
    if not _MARK.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# The model. A text is cut into islands of neighbouring chunks that hold a digit or @; within an island,
# a segmentation gives each token to a span of some type (of up to LONGEST tokens) or to none.

LONGEST = 12
_TOKEN = re.compile(r"[A-Za-z0-9_%+-]+|[^A-Za-z0-9_%+-]")
_KEY = re.compile(r"(?i)(?:token|secret|api[_-]?key|passw(?:or)?d|access[_-]?key|private[_-]?key)\W{0,5}$")
_HEX = re.compile(r"[0-9a-fA-F]{16,}|(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_WHOLE_IP = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_WHOLE_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_WHOLE_PHONE = re.compile(r"\+?[0-9(][ ().0-9-]+[0-9]")
_RUN = re.compile("[0-9]+")
_NO_DIGIT = re.compile("[^0-9]+")
_NUMERIC = frozenset("0123456789 .()+-")
_DIGITS = frozenset("0123456789")
_SIGNS = frozenset(" .()+-")
_shapes: dict[tuple, tuple[str, ...] | None] = {}


def islands(text: str) -> list[tuple[int, int]]:
    """Ranges of white-space chunks with a digit or @, joined over single blanks, with what leads up to one."""
    out: list[list[int]] = []
    pos = 0
    while m := _MARK.search(text, pos):
        a, b = m.start(), m.end()
        floor = out[-1][1] if out else 0
        while a > floor and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a - out[-1][1] <= 1:
            out[-1][1] = b
        else:
            out.append([a, b])
        pos = b
    return [(a, b) for a, b in out]


def features(text: str, a: int, b: int, kind: str) -> tuple[str, ...] | None:
    """Names of a whole span's features; None where the span can't be of this kind."""
    s = text[a:b]
    before, after = text[a - 1 : a], text[b : b + 1]
    if kind == "secret":
        if not _HEX.fullmatch(s):
            return None
        lead = bool(_KEY.search(text, max(0, a - 24), a))
        return (f"secret:lead={lead}", f"secret:long={min(len(s) // 8, 6)}", f"secret:digit={s.isdigit()}")
    digits = _NO_DIGIT.sub("", s)
    if kind == "email":
        if not _EMAIL.fullmatch(s):
            return None
        return ("email:match", f"email:before={before in _LOCAL}" if before else "email:before=no", f"email:tld={s.rpartition('.')[2].isalpha()}")
    if not digits or not (s[-1].isdigit() and (s[0].isdigit() or s[0] in "+(")):
        return None
    edge = f"{kind}:edge={before.isalnum()}{after.isalnum()}"
    if kind == "ip":
        if not _WHOLE_IP.fullmatch(s) or not _octets(s):
            return None
        return ("ip:match", edge, f"ip:dots={before == '.'}{after == '.'}")
    if kind == "card":
        if not _WHOLE_CARD.fullmatch(s) or not 13 <= len(digits) <= 19 or not luhn(digits):
            return None
        groups = re.split("[ -]", s)
        return (f"card:n={len(digits)}", edge, f"card:first={digits[0]}", f"card:even={len(groups) == 1 or len({len(g) for g in groups[:-1]}) == 1 and min(map(len, groups)) > 2}")
    if not _WHOLE_PHONE.fullmatch(s) or not 9 <= len(digits) <= 15:
        return None
    shape = _RUN.sub(lambda m: str(len(m[0])), s)
    return (f"phone:plus={s[0] == '+'}", edge, f"phone:plain={s.isdigit()}", f"phone:shape={shape.lstrip('+')[-9:]}")


def _lattice(text: str, a: int, b: int):
    """Token ends, and for each end position the segments (start token, type number, features) that end there.

    A number of any type has at most 19 digits and only numeric tokens, an address reaches its @ over tokens
    of its characters: from each token only ends within these bounds are tried.
    """
    cuts = [a, *(m.end() for m in _TOKEN.finditer(text, a, b))]
    n = len(cuts) - 1
    arcs: list[list] = [[] for _ in cuts]
    digits, shape = [0] * (n + 1), [""] * n  # digits before a token; its digits as the length of their runs
    stop, at = [0] * (n + 1), [-1] * (n + 1)  # where the numeric tokens from here end; the @ that local tokens lead to
    for k in range(n):
        s = text[cuts[k] : cuts[k + 1]]
        stop[k], held = k, 0
        if s in _SIGNS:
            shape[k] = s
        elif _NUMERIC.issuperset(s):
            held = len(_NO_DIGIT.sub("", s))
            shape[k] = _RUN.sub(_length, s) if held < len(s) else str(held)
        else:
            stop[k] = -1
        digits[k + 1] = digits[k] + held
    for k in range(n - 1, -1, -1):
        c = text[cuts[k]]
        at[k] = k if c == "@" else at[k + 1] if c in _LOCAL else -1
        stop[k] = k if stop[k] < 0 else k + 1 if k + 1 == n else max(stop[k + 1], k + 1)
    for i in range(n):
        c = text[cuts[i]]
        if c not in _LOCAL and c != "(":
            continue
        last = min(i + 2 * LONGEST, n)
        if at[i] > i:
            for j in range(at[i] + 2, last + 1):
                if f := features(text, cuts[i], cuts[j], "email"):
                    arcs[j].append((i, 0, f))
                if text[cuts[j - 1]] not in _LOCAL:
                    break
        end = min(last, stop[i])
        if end > i and (c in _DIGITS or c in "+("):
            d = digits[i]
            if end >= i + 7 and 4 <= digits[i + 7] - d <= 12 and text[cuts[i + 1]] == "." and (f := features(text, cuts[i], cuts[i + 7], "ip")):
                arcs[i + 7].append((i, 1, f))
            for j in range(bisect_left(digits, d + 9, i + 1, end + 1), bisect_right(digits, d + 19, i + 1, end + 1)):
                if text[cuts[j] - 1] in _DIGITS:
                    held = digits[j] - d
                    if held >= 13 and (f := features(text, cuts[i], cuts[j], "card")):
                        arcs[j].append((i, 2, f))
                    if held <= 15 and (f := _phone(text, cuts[i], cuts[j], "".join(shape[i:j]))):
                        arcs[j].append((i, 3, f))
        if cuts[i + 1] - cuts[i] >= 16 and (f := features(text, cuts[i], cuts[i + 1], "secret")):
            arcs[i + 1].append((i, 4, f))
    return cuts, arcs


def _length(m: re.Match) -> str:
    return str(m.end() - m.start())


def _phone(text: str, a: int, b: int, shape: str):
    """The features of a phone number, remembered by its shape and edges, on which alone they rest."""
    key = shape, text[a - 1 : a].isalnum(), text[b : b + 1].isalnum()
    if key not in _shapes:
        if len(_shapes) >= 100_000:
            _shapes.clear()
        _shapes[key] = features(text, a, b, "phone")
    return _shapes[key]


@dataclass
class PiiModel:
    weights: dict[str, float]
    #: Of feature lists that were decoded; weights must not change any more then.
    scores: dict[tuple, float] = field(default_factory=dict, compare=False, repr=False)

    def score(self, f) -> float:
        return sum(self.weights.get(x, -1.0) for x in f)


def _forward(model: PiiModel, cuts, arcs) -> np.ndarray:
    alpha = np.zeros(len(cuts))
    for j in range(1, len(cuts)):
        alpha[j] = np.logaddexp.reduce([alpha[j - 1], *(alpha[i] + model.score(f) for i, _, f in arcs[j])])
    return alpha


def decode(model: PiiModel, text: str, a: int, b: int) -> list[Span]:
    """The best segmentation of an island."""
    cuts, arcs = _lattice(text, a, b)
    best, back, scores = [0.0] * len(cuts), [None] * len(cuts), model.scores
    if len(scores) > 100_000:
        scores.clear()
    for j in range(1, len(cuts)):
        best[j] = best[j - 1]
        for i, t, f in arcs[j]:
            if f not in scores:
                scores[f] = model.score(f)
            if (s := best[i] + scores[f]) > best[j]:
                best[j], back[j] = s, (i, t)
    out, j = [], len(cuts) - 1
    while j > 0:
        if back[j] is None:
            j -= 1
        else:
            i, t = back[j]
            out.append((TYPES[t], cuts[i], cuts[j]))
            j = i
    return out[::-1]


def _parts(cuts, arcs):
    """The lattice cut at every place that no segment covers, as far as there are segments: the likelihood is the product over these parts."""
    begin, reach, k = 0, 0, len(cuts)
    first = [j for j in range(k)]
    for j in range(k):
        for i, *_ in arcs[j]:
            first[i] = max(first[i], j)
    for j in range(k):
        if j >= reach:
            if reach > begin:
                yield begin, reach
            begin = j
        reach = max(reach, first[j])


def train(texts: list[str], rounds: int = 60, rate: float = 0.5, most_arcs: int = 50_000) -> PiiModel:
    """Fit the weights by gradient ascent on the likelihood of silver segmentations.

    Silver spans are the pattern matches, and keys that stand in an assignment. Seed islands written
    here (not taken from any data) go along, so that every feature has some support. Texts are taken in
    their order until their lattices hold ``most_arcs`` segments, which bounds the time.
    """
    seeds = ["call (415) 555-2671 now", "415-555-2671", "mail a.b@c.org", "10.1.2.3", "+44 20 7946 0958", "4111 1111 1111 1111", "version 1.2.3.4.5", "in 1999 2004 2011", "token = \"9f86d081884c7d659a2feaa0c55ad015\"", "9f86d081884c7d659a2feaa0c55ad015", "12 4111111111111111", "12345678901", "order 1234567890123"]
    silver = {seeds[0]: [("phone", 5, 19)], seeds[1]: [("phone", 0, 12)], seeds[10]: [("card", 3, 19)], seeds[6]: [], seeds[11]: [], seeds[12]: []}
    data, held = [], 0
    for text in [*seeds * 3, *texts]:
        if held >= most_arcs:
            break
        gold = silver.get(text)
        if gold is None:
            gold = base_spans(text)
        for a, b in islands(text):
            cuts, arcs = _lattice(text, a, b)
            place = {c: k for k, c in enumerate(cuts)}
            want = {(place[x], place[y], TYPES.index(k)) for k, x, y in gold if x in place and y in place and a <= x and y <= b}
            want |= {(i, j, t) for j, s in enumerate(arcs) for i, t, f in s if "secret:lead=True" in f}
            for x, y in _parts(cuts, arcs):
                own = [[(i - x, t, f) for i, t, f in s] for s in arcs[x : y + 1]]
                own[0] = []  # those belong to the part before
                data.append((cuts[x : y + 1], own, [f for j, s in enumerate(own) for i, t, f in s if (i + x, j + x, t) in want]))
                held += sum(map(len, own))
    model = PiiModel({f: 0.0 for _, arcs, _ in data for s in arcs for *_, fs in s for f in fs})
    for _ in range(rounds):
        grad = dict.fromkeys(model.weights, 0.0)
        for cuts, arcs, gold in data:
            alpha = _forward(model, cuts, arcs)
            beta = np.full(len(cuts), -np.inf)
            beta[-1] = 0.0
            for j in range(len(cuts) - 1, 0, -1):
                beta[j - 1] = np.logaddexp(beta[j - 1], beta[j])
                for i, _, f in arcs[j]:
                    w = model.score(f) + beta[j]
                    p = np.exp(alpha[i] + w - alpha[-1])
                    beta[i] = np.logaddexp(beta[i], w)
                    for x in f:
                        grad[x] -= p
            for f in gold:
                for x in f:
                    grad[x] += 1.0
        for x, g in grad.items():
            model.weights[x] += rate * (g / max(1, len(data)) * 10 - 0.002 * model.weights[x])
    return model


def fit(docs: DataFrame, texts: int = 300, longest: int = 20_000) -> PiiModel:
    """Train on about ``texts`` texts with a digit or @, none over ``longest`` characters, picked by a hash of doc_id.

    How many there are is told by 64 times as many rows, or by all where these hold too few, so that only
    about ``texts`` (twice as many at most, in the order of the hash) ever leave the executors. Without such
    texts, as in an empty table, the seed islands train the model.
    """
    fits = F.char_length("text").between(1, longest) & F.col("text").rlike("[0-9]{5}|@|[0-9][.][0-9]")
    rows, own = docs.count(), docs.select("doc_id", "text")
    seen = own.where(sampled("doc_id", 64 * texts, rows)).agg(F.count(F.lit(1)).alias("n"), F.count_if(fits).alias("hit")).first()
    total = rows * seen["hit"] // seen["n"] if seen["hit"] >= 64 else own.where(fits).count()
    found = own.where(sampled("doc_id", texts, total)).where(fits)
    return train([r["text"] for r in found.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * texts).collect()])


def find(text: str, model: PiiModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and the model's spans that touch none of them, each by kind, then start."""
    base = base_spans(text)
    if not base and not _MARK.search(text):
        return [], []
    taken = merged([(a, b) for _, a, b in base])
    starts, more = [a for a, _ in taken], []
    for a, b in islands(text):
        for s in decode(model, text, a, b):
            k = bisect_left(starts, s[2]) - 1  # the last that starts before its end
            if k < 0 or taken[k][1] <= s[1]:
                more.append(s)
    order = {k: i for i, k in enumerate(TYPES)}
    return base, sorted(more, key=lambda s: (order[s[0]], s[1]))


def _join(spans) -> str:
    order = {k: i for i, k in enumerate(TYPES)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def spans(docs: DataFrame, model: PiiModel) -> DataFrame:
    """doc_id, the count of base matches of each kind, base_sha256 over them and all spans as text.

    Spans are kind:start:end in code points, end exclusive. A null or empty text has none; rows repeat as
    they come; work is linear in the text's length. Nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                base, more = find(t or "", model)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(_join(base).encode()).hexdigest(), _join(base + more)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """``docs``, all rows and columns, each span in text replaced by its kind, as in <EMAIL>; n_chars, if there, is kept in step.

    Null and empty texts stay as they are, rows that repeat are changed alike, an empty table stays empty,
    and further columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(t):
        if not t or not _MARK.search(t):
            return t
        base, more = find(t, model)
        out, end = [], 0
        for k, a, b in sorted(base + more, key=lambda s: (s[1], -s[2])):
            if b <= end:
                continue
            out += [t[end : max(a, end)], f"<{k.upper()}>"]
            end = b
        return "".join([*out, t[end:]])

    def run(batches):
        for b in batches:
            new = [clean(t) for t in b.column(at).to_pylist()]
            b = b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))
            if size is not None and pa.types.is_integer(b.schema.field(size).type):
                b = b.set_column(size, b.schema.field(size), pa.array([None if t is None else len(t) for t in new], b.schema.field(size).type))
            yield b

    return docs.mapInArrow(run, docs.schema)
