"""Personal data by patterns and a skip-chain conditional random field."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcript_lake.llm.binary import slices
from transcript_lake.llm.common import hashed_sample, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)

#: The field is fitted on about so many texts, those of the least hash among the ones with a digit or an @.
TRAIN_TEXTS = 2_000

#: A word joins a span only if the field gives its label so much.
MIN_PROBABILITY = 0.9

#: The fit: steps uphill, their size, and the weight of the squared potentials against the sample's pseudo-likelihood.
STEPS, PACE, RIDGE = 300, 0.1, 0.5

#: Messages are sent until none changes by more than SETTLED; ROUNDS ends the rare ones that never settle.
ROUNDS, SETTLED = 1_000, 1e-3
DAMPING = 0.5

#: Words beside a suspicious one that are nodes too.
CONTEXT = 2

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SUSPECT = re.compile(r"[^\x20\x09-\x0D0-9@]*[0-9@][^\x20\x09-\x0D]*")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit before would belong to the run, so looking behind changes no match but spares tries inside a run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        v = int(x)
        total += v if k % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, leftmost and without overlap in each kind, failing ones dropped."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        lo = at
        if m:
            while lo > end and text[lo - 1] in LOCAL:
                lo -= 1
            if lo < at:
                end = m.end()
                out.append(("email", lo, end))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.sub("", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def traits(word: str) -> list[str]:
    """What the field sees of a word: its shape and whether its numbers can be right, not whether a pattern matches it."""
    digits, dots = sum(x in "0123456789" for x in word), word.count(".")
    letters = sum(map(str.isalpha, word))
    inner = any(x in "0123456789._+-" for x in word.strip(".,;:!?\"'()[]<>{}#*$%&|=+-_")) and letters > 0
    out = [f"digits {min(digits, 16) if digits < 16 else 16}", f"dots {min(dots, 4)}", f"letters {min(letters, 3)}", f"at {word.count('@') if word.count('@') < 2 else 2}"]
    if inner:
        out.append("joined")
    out.append("first " + ("digit" if word[0] in "0123456789" else "letter" if word[0].isalpha() else word[0] if word[0] in "+(@#" else "sign"))
    if digits:
        groups = [len(x) for x in re.findall("[0-9]+", word)]
        out.append(f"groups {min(len(groups), 5)} longest {min(max(groups), 16)}")
        if digits >= 13:
            out.append("sum " + ("right" if luhn(DIGITS.sub("", word)) else "wrong"))
        if dots == 3 and len(groups) == 4:
            out.append("parts " + ("small" if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in re.findall("[0-9]+", word))) else "large"))
    return out


def key(word: str) -> str | None:
    """What similar words have in common: seven digits or more alone, whatever parts them; an address's part before the @; else the lower-case word without signs around."""
    digits = DIGITS.sub("", word)
    if len(digits) >= 7:
        return digits
    core = word.partition("@")[0].strip(".,;:!?\"'()[]<>{}#*$%&|").lower()
    return core if len(core) >= 4 else None


class Graph:
    """The nodes of many documents: suspicious words, words like them, and their neighbours.

    All other words are fixed as other: they have no digit and no @, are like no word that has, and touch none.
    Edges join neighbours in the text and, however distant, like words: each occurrence with the first one that a pattern gives a kind
    (once for each kind), so that the kind reaches all alike, or, where no pattern gives one, each two that follow one another.
    skip has those that follow one another, which the field is fitted on; like, those that labels take."""

    def __init__(self) -> None:
        self.doc, self.start, self.end, self.words, self.traits, self.label = [], [], [], [], [], []
        self.chain, self.skip, self.like = [], [], []

    def add(self, number: int, text: str, spans: list[tuple[str, int, int]]) -> None:
        words = [(m.start(), m.end()) for m in WORDS.finditer(text)]
        suspect = [k for k, (lo, hi) in enumerate(words) if "@" in text[lo:hi] or any(x in text[lo:hi] for x in "0123456789")]
        keys = {key(text[words[k][0] : words[k][1]]) for k in suspect} - {None}
        like = [k for k, (lo, hi) in enumerate(words) if key(text[lo:hi]) in keys] if keys else []
        chosen = sorted({j for k in {*suspect, *like} for j in range(max(0, k - CONTEXT), min(len(words), k + CONTEXT + 1))})
        covered, at, reach = sorted(spans, key=lambda s: s[1]), 0, []
        last: dict[str, int] = {}
        alike: dict[str, list[int]] = {}
        previous = None
        for j in chosen:
            lo, hi = words[j]
            while at < len(covered) and covered[at][1] < hi:
                reach.append(covered[at])
                at += 1
            reach = [s for s in reach if s[2] > lo]  # of one kind, spans do not overlap
            kind = next((s[0] for s in reach), "other")
            node, word = len(self.words), text[lo:hi]
            self.doc.append(number)
            self.start.append(lo)
            self.end.append(hi)
            self.words.append(word)
            self.traits.append(traits(word))
            self.label.append(LABELS.index(kind))
            if previous == j - 1:
                self.chain.append((node - 1, node))
            previous = j
            name = key(word)
            if name in keys:
                if name in last:
                    self.skip.append((last[name], node))
                last[name] = node
                alike.setdefault(name, []).append(node)
        for nodes in alike.values():
            first: dict[int, int] = {}
            for node in nodes:
                if self.label[node]:
                    first.setdefault(self.label[node], node)
            if first:
                self.like += [(f, node) for f in first.values() for node in nodes if not self.label[node]]
            else:
                self.like += zip(nodes[:-1], nodes[1:], strict=True)


def seen(g: Graph) -> Iterator[str]:
    """What the fit counts: of each node whose label is known its label, traits, neighbours' labels and, of like words beside it in
    the order of the text, labels; "-" where there is none. Words that no pattern covers but that are like one in the text that a pattern
    does have an unknown label. So that like words teach what a mention in another form is, each labelled word is seen
    again in its bare form: of its kind beside a like word of its kind, and, if no pattern knows that form, as other alone and beside like words that are other. Matches that fail a check are covered by none, so they count as other."""
    labelled = {(g.doc[k], key(w)) for k, w in enumerate(g.words) if g.label[k]}
    known = [bool(g.label[k]) or (g.doc[k], key(w)) not in labelled for k, w in enumerate(g.words)]
    left, right, like = {}, {}, {}
    for a, b in g.chain:
        left[b], right[a] = a, b
    for a, b in g.skip:
        like.setdefault(a, []).append(b)
        like.setdefault(b, []).append(a)
    name = lambda k: str(g.label[k]) if k is not None and known[k] else "-"
    for k, word in enumerate(g.words):
        if not known[k]:
            continue
        beside = sorted(str(g.label[j]) for j in like.get(k, []) if known[j])
        yield "\t".join([str(g.label[k]), name(left.get(k)), name(right.get(k)), "".join(beside), *g.traits[k]])
        bare = key(word)
        if g.label[k] and bare:
            yield "\t".join([str(g.label[k]), "-", "-", str(g.label[k]), *traits(bare)])
            if not base_spans(bare):
                for like_too in ("", "0", "00"):
                    yield "\t".join(["0", "-", "-", like_too, *traits(bare)])


class Field:
    """Log-linear potentials of traits, of neighbours and of like words, fitted together: they maximise the pseudo-likelihood of the
    labels that the patterns give (each label given its neighbours'), less a penalty on their squares."""

    def __init__(self, counts: dict[str, int]) -> None:
        n = len(LABELS)
        rows = [(x.split("\t"), c) for x, c in sorted(counts.items())]
        self.names = {t: i for i, t in enumerate(sorted({t for r, _ in rows for t in r[4:]}))}
        weight = np.array([c for _, c in rows], float)
        y = np.array([int(r[0]) for r, _ in rows], np.int64)
        have = np.zeros((len(rows), len(self.names) + 1))
        have[:, -1] = 1
        left, right, beside = (np.zeros((len(rows), n)) for _ in range(3))
        for i, (r, _) in enumerate(rows):
            have[i, [self.names[t] for t in r[4:]]] = 1
            for where, labels in ((left, r[1]), (right, r[2]), (beside, r[3])):
                for z in labels.replace("-", ""):
                    where[i, int(z)] += 1
        sizes = (have.shape[1], n, n)
        p, mean, square = (np.zeros((sum(sizes), n)) for _ in range(3))
        for step in range(1, STEPS + 1 if rows else 1):
            own, chain, skip = np.split(p, np.cumsum(sizes)[:2])
            off = (np.eye(n)[y] - normal(have @ own + left @ chain + right @ chain.T + beside @ skip)) * weight[:, None]
            up = np.concatenate([have.T @ off, left.T @ off + (right.T @ off).T, beside.T @ off])
            up[-n:] = (up[-n:] + up[-n:].T) / 2
            up = (up - RIDGE * p) / weight.sum()
            mean, square = 0.9 * mean + 0.1 * up, 0.99 * square + 0.01 * up * up
            p = p + PACE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        own, self.chain, self.skip = np.split(p, np.cumsum(sizes)[:2])
        self.trait, self.prior = {t: own[i] for t, i in self.names.items()}, own[-1]

    def marginals(self, g: Graph) -> np.ndarray:
        """Label probabilities of each node by damped loopy sum-product; nodes in the patterns' matches are held at their kinds."""
        n, k = len(g.words), len(LABELS)
        unary = np.stack([self.prior + sum((self.trait[t] for t in ts if t in self.trait), np.zeros(k)) for ts in g.traits])
        label = np.array(g.label)
        unary[label > 0] = -30.0
        unary[label > 0, label[label > 0]] = 0.0
        edges = np.array(g.chain + g.like, np.int64).reshape(-1, 2)
        if not len(edges):
            return normal(unary)
        pots = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), k, k)), np.broadcast_to(self.skip, (len(g.like), k, k))])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pots = np.concatenate([pots, pots.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(src), k))
        for _ in range(ROUNDS):
            belief = unary + np.stack([np.bincount(dst, messages[:, y], n) for y in range(k)], 1)
            x = (belief[src] - messages[back])[:, :, None] + pots
            top = x.max(1, keepdims=True)
            new = np.log(np.exp(x - top).sum(1)) + top[:, 0]
            new = DAMPING * messages + (1 - DAMPING) * (new - new.max(1, keepdims=True))
            change, messages = np.abs(new - messages).max(), new
            if change <= SETTLED:
                break
        return normal(unary + np.stack([np.bincount(dst, messages[:, y], n) for y in range(k)], 1))


def normal(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def added_spans(g: Graph, probabilities: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Words that the field labels and no pattern covers; neighbours of one label are one span, signs around it are cut off."""
    best = probabilities.argmax(1)
    out: dict[int, list[list]] = {}
    for k in np.flatnonzero((best > 0) & (probabilities.max(1) >= MIN_PROBABILITY) & (np.array(g.label) == 0)).tolist():
        word, lo = g.words[k], g.start[k]
        core = word.strip(".,;:!?\"'()[]<>{}#*$%&|=")
        if not core:
            continue
        lo += word.index(core)
        spans, kind = out.setdefault(g.doc[k], []), LABELS[best[k]]
        if spans and spans[-1][0] == kind and g.start[k] - spans[-1][3] == 1:
            spans[-1][2:] = [lo + len(core), g.end[k]]
        else:
            spans.append([kind, lo, lo + len(core), g.end[k]])
    return {d: [(a, b, c) for a, b, c, _ in spans] for d, spans in out.items()}


def possible(kind: str, found: str) -> bool:
    """Whether a span's numbers can be right: a card's sum, an address's parts."""
    if kind == "card":
        digits = DIGITS.sub("", found)
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "ip" or any(k == "ip" for k, _, _ in base_spans(found))


def suspicious(text: str) -> bool:
    return SUSPECT.search(text) is not None


def fit(docs: DataFrame, text: str = "text", texts: int = TRAIN_TEXTS) -> Field:
    """The field, from about `texts` texts with a digit or an @: those of the least hash, copies once. Tasks count; the
    driver gets the sums, one for each label with its traits and neighbours that occurs in the sample."""

    def count(batches):
        sums: Counter[str] = Counter()
        for _, values in slices(batches, 0):
            g = Graph()
            for k, x in enumerate(values):
                g.add(k, x, base_spans(x))
            sums.update(seen(g))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["name", "count"])

    sample = hashed_sample(docs.where(F.col(text).rlike("[0-9@]")), text, texts)
    sums = sample.repartition(16).mapInArrow(count, "name string, count long").groupBy("name").agg(F.sum("count").alias("count"))
    return Field({r["name"]: r["count"] for r in sums.toLocalIterator()})


def find(texts: list[str], field: Field) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text, the patterns' spans and the spans that the field adds."""
    g, base = Graph(), []
    for k, x in enumerate(texts):
        base.append(base_spans(x) if suspicious(x) else [])
        if suspicious(x):
            g.add(k, x, base[-1])
    more = added_spans(g, field.marginals(g)) if g.words else {}
    for k, spans in enumerate(base):
        yield spans, [s for s in more.get(k, []) if possible(s[0], texts[k][s[1] : s[2]]) and all(s[2] <= b or s[1] >= e for _, b, e in spans)]


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{lo}:{hi}" for k, lo, hi in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; where spans of several kinds overlap, the first one's kind stands for all."""
    out, at = [], 0
    for kind, lo, hi in sorted(spans, key=lambda s: (s[1], -s[2])):
        if lo >= at:
            out += [text[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind: string, start: long, end: long>>"


def find_pii(docs: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """docs with base and added (arrays of spans: kind, start, end in code points) and redacted, the text without them.

    Null text: no spans, and redacted is null. Each row on its own, so repeated rows repeat and ties can't arise. No rows: no
    rows, and a field fitted on nothing. Columns of docs named base, added or redacted are replaced."""
    field = field or fit(docs, text)
    kept = [c for c in docs.columns if c not in ("base", "added", "redacted")]
    place = kept.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch, texts in slices(batches, place):
            got = list(find(texts, field))
            whole = batch.column(place)
            arrays = [pa.array([[{"kind": k, "start": lo, "end": hi} for k, lo, hi in x[j]] for x in got], kind) for j in (0, 1)]
            clean = pa.array([None if null else redacted(t, [*a, *b]) if a or b else t for t, (a, b), null in zip(texts, got, whole.is_null().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays, clean], names=[*kept, "base", "added", "redacted"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes) + f", base {SPAN}, added {SPAN}, redacted string"
    return docs.select(*kept).mapInArrow(run, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = {k: i for i, k in enumerate(KINDS)}

    def text(spans):
        place = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), s["kind"])
        ranked = F.array_sort(F.transform(spans, lambda s: F.struct(place(s).alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select("doc_id", *map(count, KINDS), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
