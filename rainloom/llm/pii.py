"""Personal data by a semi-Markov conditional random field.

Loose patterns propose candidate segments.  Each is scored as a whole (digit
count, grouping, separators, checksum, neighbours, cue words), and a dynamic
programme over a stretch's boundaries chooses segments and their kinds
together, with a weight for each kind after the kind before it in the stretch;
a segment spans a bounded number of units.  Weights are fitted by
maximum likelihood on stretches of the corpus, labelled by the fixed patterns,
and on generated examples of forms that those leave out.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm import common, spans

KINDS = ("email", "ip", "card", "phone")
#: Stretches of the corpus that the fit reads at most (chosen by hash), their length in characters, and its passes.
FIT_STRETCHES, STRETCH_CHARS, PASSES = 1500, 200, 12
#: Groups of digits that a segment spans at most, and its most digits.
MOST_GROUPS, MOST_DIGITS = 10, 19

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HAS = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 - 9 if n > 4 else n * 2)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind; a failing match is dropped for good."""
    found = []
    if "@" in text:
        upto = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > upto and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                upto = m.end()
    if _HAS.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(_small(p) for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


_NUMBERS = re.compile(r"\+?\(?[0-9]+(?:[ .()/-]{1,2}[0-9]+)*")
_GROUP = re.compile(r"[0-9]+")
_MAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}(?:@| ?[\[(]at[\])] ?)[\w-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?)[\w-]{1,63}){0,6}", re.A | re.I)
_CUE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")
#: Words before a segment that are features of their own.
CUES = frozenset("tel phone call fax mobile card visa ip host server mail email contact version order page no nr date".split())


def _bucket(n: int) -> str:
    return str(n) if n <= 8 else "9-10" if n <= 10 else "11-12" if n <= 12 else "13-15" if n <= 15 else str(n)


def _beside(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+-./:@#$%" else "sign"


def candidates(text: str, start: int, end: int) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """Segments proposed in text[start:end]: (start, end, kind, features)."""
    out = []

    def add(s: int, e: int, kind: str, features: list[str]) -> None:
        cue = _CUE.search(text, max(0, s - 16), s)
        word = cue.group(1).lower() if cue else ""
        features += ["left=" + _beside(text, s - 1), "right=" + _beside(text, e), "cue=" + (word if word in CUES else "-")]
        out.append((s, e, kind, tuple(f"{kind}:{f}" for f in ["any", *features])))

    for m in _MAIL.finditer(text, start, end):
        whole = m.group()
        tail = re.split(r"\.|dot[\])] ?", whole)[-1]
        add(m.start(), m.end(), "email", [
            "at" if "@" in whole else "written", "dotted" if re.search(r"(\.|dot[\])])\s?[\w-]+$", whole, re.A | re.I) else "bare",
            "tail=" + ("letters" if tail.isalpha() and len(tail) >= 2 else "other")])
    for m in _NUMBERS.finditer(text, start, end):
        groups = [(g.start(), g.end()) for g in _GROUP.finditer(text, m.start(), m.end())]
        for i, (first, _) in enumerate(groups):
            s = first
            while s > m.start() and text[s - 1] in "+(" and first - s < 2:
                s -= 1
            total, seps = 0, ""
            for j in range(i, min(i + MOST_GROUPS, len(groups))):
                if j > i:
                    seps += text[groups[j - 1][1]:groups[j][0]]
                total += groups[j][1] - groups[j][0]
                if total > MOST_DIGITS:
                    break
                e, digits = groups[j][1], None
                if total < 4:
                    continue
                used = "".join(sorted(set(seps + text[s:first])))
                lengths = [b - a for a, b in groups[i:j + 1]]
                whole = i == 0 and j == len(groups) - 1
                shared = ["n=" + _bucket(total), "groups=" + str(len(lengths)), "seps=" + used, "whole" if whole else "part"]
                if j - i == 3 and seps == "...":
                    add(s, e, "ip", shared + ["small" if all(_small(text[a:b]) for a, b in groups[i:j + 1]) else "large"])
                if total >= 12 and not set(used) - set(" -"):
                    digits = _digits(text[s:e])
                    add(s, e, "card", shared + ["luhn" if luhn(digits) else "noluhn", "even" if set(lengths[:-1]) <= {4} else "uneven"])
                if 7 <= total <= 15 and "/" not in used:
                    add(s, e, "phone", shared + [
                        "plus" if "+" in used else "area" if "(" in used else "plain",
                        "lengths=" + "-".join(map(str, lengths)) if len(lengths) <= 4 else "many",
                        "zero" if text[first] == "0" else "nonzero"])
    return out


@dataclass(frozen=True)
class Model:
    """Weights of the features of segments, and of ``before>kind`` for a kind and the one before it ("" for none)."""

    weights: dict[str, float]

    def score(self, features: tuple[str, ...]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def follows(self, before: str, kind: str) -> float:
        return self.weights.get(f"{before}>{kind}", 0.0)


#: States of the lattice: the kind of the last segment, or none yet.
STATES = ("", *KINDS)


def _lattice(found, bounds):
    at = {b: i for i, b in enumerate(bounds)}
    ending = defaultdict(list)
    for s, e, kind, features in found:
        ending[at[e]].append((at[s], kind, features))
    return ending


def decode(found, model: Model) -> list[tuple[str, int, int]]:
    """The best sequence of segments: ties go to fewer segments, then to the first proposed."""
    bounds = sorted({b for s, e, _, _ in found for b in (s, e)})
    ending = _lattice(found, bounds)
    step = {(a, b): model.follows(a, b) for a in STATES for b in KINDS}
    # for each boundary and last kind: score, less segments, and the segment that led there (start, kind before it)
    best: list[dict[str, tuple[float, int, tuple[int, str] | None]]] = [{"": (0.0, 0, None)}]
    for j in range(1, len(bounds)):
        top = {state: (score, segments, None) for state, (score, segments, _) in best[j - 1].items()}
        for i, kind, features in ending[j]:
            own = model.score(features)
            for before, (score, segments, _) in best[i].items():
                value = (score + own + step[before, kind], segments - 1, (i, before))
                if kind not in top or value[:2] > top[kind][:2]:
                    top[kind] = value
        best.append(top)
    j = len(bounds) - 1
    out, state = [], max(best[j], key=lambda k: best[j][k][:2])
    while j > 0:
        came = best[j][state][2]
        if came is None:
            j -= 1
        else:
            out.append((state, bounds[came[0]], bounds[j]))
            j, state = came
    return out[::-1]


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def _gradient(found, gold: set[tuple[str, int, int]], model: Model) -> dict[str, float]:
    """Observed minus expected features of one stretch, by forward and backward sums over all segmentations and kinds.

    The spans of ``gold`` do not overlap; those that are no candidates count as absent.
    """
    bounds = sorted({b for s, e, _, _ in found for b in (s, e)})
    last = len(bounds) - 1
    number = {k: n for n, k in enumerate(STATES)}
    step = [[model.follows(a, b) for b in STATES] for a in STATES]
    scored = {j: [(i, number[kind], f, model.score(f)) for i, kind, f in own] for j, own in _lattice(found, bounds).items()}
    never, states = -math.inf, range(len(STATES))
    ahead = [[0.0] + [never] * len(KINDS)]
    for j in range(1, last + 1):
        sums = [[v] for v in ahead[j - 1]]
        for i, k, _, w in scored.get(j, ()):
            sums[k] += [ahead[i][a] + step[a][k] + w for a in states]
        ahead.append([_log_add(v) for v in sums])
    starting = defaultdict(list)
    for j, own in scored.items():
        for i, k, _, w in own:
            starting[i].append((j, k, w))
    back = [[0.0] * len(STATES) for _ in bounds]
    for i in range(last - 1, -1, -1):
        for a in states:
            back[i][a] = _log_add([back[i + 1][a]] + [step[a][k] + w + back[j][k] for j, k, w in starting.get(i, ())])
    total = back[0][0]
    out: dict[str, float] = defaultdict(float)
    chosen = sorted((s, e, kind) for kind, s, e in gold & {(kind, s, e) for s, e, kind, _ in found})
    for before, (_, _, kind) in zip(["", *(kind for _, _, kind in chosen)], chosen):
        out[f"{before}>{kind}"] += 1.0
    for j, own in scored.items():
        for i, k, features, w in own:
            expected = 0.0
            for a in states:
                share = math.exp(ahead[i][a] + step[a][k] + w + back[j][k] - total)
                if share > 1e-9:
                    out[f"{STATES[a]}>{STATES[k]}"] -= share
                    expected += share
            push = float((STATES[k], bounds[i], bounds[j]) in gold) - expected
            if abs(push) > 1e-6:
                for f in features:
                    out[f] += push
    return out


def generated(rows: int = 400) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """Labelled lines from forms: # is a digit, {kind|form} a segment of that kind, other braces are none."""
    forms = (
        "tel {phone|(0##) ### ####}", "call {phone|###-###-####}", "phone: {phone|0## ### ## ##}", "fax {phone|(###) ###-####}",
        "mobile {phone|+## ### #######}", "tel. {phone|0### ######}", "mail {email|ab#@ex-#.org}",
        "contact {email|abc [at] example [dot] org}", "email {email|a.b#(at)host(dot)com}", "server {ip|10.#.##.1##}", "ip {ip|192.168.#.##}",
        "on 20##-0#-1# it", "date 1#.0#.20##", "version #.##.#", "version 3##.4##.5##.6##", "order ########", "page ### of ####", "no 4###########9#",
        "from 19## - 20## and", "pi 3.########", "#### #### in ####", "at 1#:##:## 20##/1#/2#", "nr ###-##", "sum ###.###.###", "user@host", "1## 2## 3## 4## 5##",
        "############", "#### ######## ####", "20##0###1#####", "tel {phone|0## ### ## ##} mail {email|ab#@ex-#.org}",
        "call {phone|###-###-####} or {phone|###-###-####}", "from {ip|10.#.##.1##} to {ip|10.#.##.1##}", "{email|a.b#@ex.org}, {phone|(0##) ### ####}")
    rng = np.random.default_rng(11)
    out = []
    for k in range(rows):
        text, gold, rest = "", set(), forms[k % len(forms)]
        for part in re.split(r"(\{[^}]*\})", rest):
            kind, _, form = part[1:-1].partition("|") if part.startswith("{") else ("", "", part)
            made = "".join(str(rng.integers(1, 10)) if c == "#" else c for c in form)
            if kind:
                gold.add((kind, len(text), len(text) + len(made)))
            text += made
        out.append((f"so {text} is", {(kd, s + 3, e + 3) for kd, s, e in gold}))
    return out


def apart(spans_: set[tuple[str, int, int]]) -> set[tuple[str, int, int]]:
    """Spans that do not overlap, as a segmentation has none that do: by start, the longer one first, then by kind."""
    out, upto = set(), 0
    for kind, s, e in sorted(spans_, key=lambda x: (x[1], -x[2], x[0])):
        if s >= upto:
            out.add((kind, s, e))
            upto = e
    return out


def train(examples: list[tuple[str, set[tuple[str, int, int]]]]) -> Model:
    """Weights by stochastic gradient steps (Adagrad) with a quadratic penalty; examples are visited in a fixed order."""
    seen: dict[tuple, list] = {}
    for text, gold in examples:
        found, gold = candidates(text, 0, len(text)), apart(gold)
        if found:
            form = tuple((s - found[0][0], e - found[0][0], k, f, (k, s, e) in gold) for s, e, k, f in found)
            seen.setdefault(form, [found, gold, 0])[2] += 1
    weights: dict[str, float] = {}
    squares: dict[str, float] = defaultdict(lambda: 1.0)
    model = Model(weights)
    for _ in range(PASSES):
        for found, gold, times in seen.values():
            for f, g in _gradient(found, gold, model).items():
                g = g * min(times, 20) - 0.01 * weights.get(f, 0.0)
                squares[f] += g * g
                weights[f] = weights.get(f, 0.0) + 0.5 * g / math.sqrt(squares[f])
    return Model({f: round(w, 6) for f, w in weights.items() if abs(w) > 1e-4})


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text that can hold a segment: characters around digits and @, up to white space, joined when close."""
    out: list[list[int]] = []
    for m in re.finditer(r"[0-9@]|[\[(]at[\])]", text, re.I):
        s, e = max(0, m.start() - 65), min(len(text), m.end() + 65)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Fit on at most ``FIT_STRETCHES`` distinct stretches of the corpus (least hashes) and on generated examples."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = set()
        for t in batch.column(0).to_pylist():
            if _HAS.search(t):
                own |= {t[s:min(e, s + STRETCH_CHARS)] for s, e in stretches(t)}
        return pa.RecordBatch.from_arrays([pa.array(sorted(own), pa.string())], ["stretch"])

    rows = common.in_slices(docs.select(common.text_or_empty(text)), work, "stretch string")
    hashed = F.xxhash64("stretch")
    drawn = rows.select(hashed.alias("h"), "stretch").distinct() \
        .orderBy("h", "stretch").limit(FIT_STRETCHES).collect()
    examples = [(r["stretch"], set(base_spans(r["stretch"]))) for r in drawn]
    return train(examples + generated())


def find(text: str, model: Model) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the decoded segments that touch none of them."""
    base = base_spans(text)
    extra = []
    if _HAS.search(text) or "at" in text:
        for s, e in stretches(text):
            found = candidates(text, s, e)
            if found:
                extra += [x for x in decode(found, model) if not any(x[1] < b and a < x[2] for _, a, b in base)]
    return base, extra


def detect(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``base`` and ``found`` (arrays of kind, s, e in code points) of every whole text.

    A null text counts as empty; equal keys stay separate rows.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [find(t, model) for t in batch.column(1).to_pylist()]
        rows = [[[dict(zip(("kind", "s", "e"), x)) for x in own] for own in (base, base + extra)] for base, extra in both]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([r[0] for r in rows], span), pa.array([r[1] for r in rows], span)], ["key", "base", "found"])

    rows = docs.select(docs[key].alias("key"), common.text_or_empty(text).alias("text"))
    kind = "array<struct<kind:string,s:int,e:int>>"
    return common.in_slices(rows, work, f"key {dict(rows.dtypes)['key']}, base {kind}, found {kind}").withColumnRenamed("key", key)


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, upto = [], 0
    merged: list[list] = []
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[upto:s], f"<{kind.upper()}>"]
        upto = e
    return "".join(out) + text[upto:]


def mask(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns, the text without personal data; texts that have none, and nulls, are left as they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else masked(t, sum(find(t, model), [])))

    return docs.withColumn(text, clean(docs[text]))


def n_chars(text: str = "text") -> Column:
    return F.char_length(text).cast("long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    found = detect(docs, fit(docs))
    return found.select(
        "doc_id", *(spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(spans.joined(F.col("base"), KINDS, by_kind=True), 256).alias("base_sha256"),
        spans.joined(F.col("found"), KINDS, by_kind=True).alias("spans"))
