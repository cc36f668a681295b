"""Personal data: exact base patterns, and a skip-chain conditional random field that carries labels to like tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import text_key, whole

# The kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens that can be personal data: those with a digit or an at sign.
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
_EDGE = ".,;:!?()[]{}<>\"'"

#: Documents with a digit or an at sign that the field is fitted on, the first by a hash of their text.
TRAINING_DOCUMENTS = 500
#: Messages are passed until they settle; passes after which a field that swings is left, and the belief from which a token is labelled.
PASSES, SETTLED, BELIEF = 1000, 1e-4, 0.98
#: Least weight of one label for a value and its repeats, however few repeats the sample has to learn it from.
SAME = 6.0
LABELS = len(KINDS) + 1  # 0 is none
_FEATURES = 16
#: Values with this many digits or more are alike if so many last digits are, however they are written; values that both
#: have the longer suffix meet by it first.
_ALIKE_DIGITS, _LONG_DIGITS, _MOST_DIGITS = 7, 10, 19
#: Tokens that can be parts of one value, and what stands between such parts: blanks, brackets and hyphens.
_PART = re.compile(r"[0-9+().\[\]-]+")
_JOINT = re.compile(r"[\x20\x09-\x0D()\[\]-]*")


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their at signs, so that long words without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        match = _DOMAIN.match(text, at) if begin < at else None
        if match:
            yield begin, match.end()
            free = match.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of the base patterns, by start and then kind."""
    found = [(b, 0, e) for b, e in _emails(text)]
    if re.search(r"[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() and c.isascii() for c in m[0]) <= 15]
    return sorted(found)


def tokens_of(text: str) -> list[tuple[int, int]]:
    """Places of the tokens with a digit or an at sign, without the punctuation around them."""
    out = []
    for m in _TOKEN.finditer(text):
        core = m[0].strip(_EDGE)
        if core:
            begin = m.start() + m[0].index(core)
            out.append((begin, begin + len(core)))
    return out


def _shape(token: str, before: str) -> np.ndarray:
    """What a token looks like; nothing of this asks a base pattern."""
    n = len(token)
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    return np.array([1.0, digits / n, letters / n, "@" in token, token.count(".") == 1, token.count(".") >= 3, "-" in token,
                     token[:1] == "+" or before == "+", before == "(" or ")" in token, digits <= 2, 3 <= digits <= 6, 7 <= digits <= 12, digits >= 13,
                     any("a" <= c <= "f" for c in token) and digits > 4, " " in token,
                     digits >= 13 and token[:1] in tuple("3456")], float)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _is_ip(text: str) -> bool:
    return bool(_IP.fullmatch(text)) and all(int(part[-4:]) <= 255 for part in text.split("."))


def _value(text: str) -> str:
    """What repeats are known by: the digits if there are enough, else the letters."""
    digits = _digits(text)
    return digits if len(digits) >= _ALIKE_DIGITS and "@" not in text and not _is_ip(text) else text.lower()


def _nodes(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """Nodes (begin, end, label or -1, value): tokens of one base span together, and joined parts of other values.

    Parts that stand side by side are one value where their last digits are those of a base value, the longest common
    suffix first and then the fewest parts. Other parts are joined if all of them have as many digits as one value can have.
    """
    ordered = sorted(spans, key=lambda s: (s[0], s[2]))
    base = [_value(text[b:e]) for b, _, e in ordered]
    suffixes = {v[-n:] for v in base if v.isdigit() for n in range(_ALIKE_DIGITS, min(len(v), _MOST_DIGITS) + 1)}
    nodes: list[tuple[int, int, int, str]] = []
    run: list[tuple[int, int]] = []

    def close() -> None:
        digits = [_digits(text[b:e]) for b, e in run]
        ends = []
        for last in range(len(run)) if suffixes else ():
            joined, first, best = "", last, (0, 0)
            while first >= 0 and len(joined) + len(digits[first]) <= _MOST_DIGITS:
                joined = digits[first] + joined
                sizes = (len(joined), _LONG_DIGITS, _ALIKE_DIGITS)
                common = next((n for n in sizes if _ALIKE_DIGITS <= n <= len(joined) and joined[-n:] in suffixes), 0)
                best = max(best, (common, first))
                first -= 1
            if best[0]:
                ends.append((-best[0], last - best[1], best[1], last))
        owner = [-1] * len(run)
        for n, (_, _, first, last) in enumerate(sorted(ends)):
            if max(owner[first:last + 1]) < 0:
                owner[first:last + 1] = [n] * (last - first + 1)
        at = 0
        while at < len(run):
            stop = at + 1
            while stop < len(run) and owner[stop] == owner[at]:
                stop += 1
            whole_value = owner[at] >= 0 or _ALIKE_DIGITS <= sum(map(len, digits[at:stop])) <= _MOST_DIGITS
            for first, last in [(at, stop)] if whole_value else [(n, n + 1) for n in range(at, stop)]:
                begin, end = run[first][0], run[last - 1][1]
                nodes.append((begin, end, -1, _value(text[begin:end])))
            at = stop
        run.clear()

    at, inside = 0, -1
    for begin, end in tokens_of(text):
        while at < len(ordered) and ordered[at][2] <= begin:
            at += 1
        k = at
        while k < len(ordered) and ordered[k][0] < end and ordered[k][2] <= begin:
            k += 1
        if k < len(ordered) and ordered[k][0] < end:
            close()
            if inside == k:
                nodes[-1] = (nodes[-1][0], end, *nodes[-1][2:])
            else:
                nodes.append((begin, end, ordered[k][1] + 1, base[k]))
            inside = k
            continue
        inside = -1
        part = _PART.fullmatch(text, begin, end) and not _is_ip(text[begin:end])
        if run and not (part and _JOINT.fullmatch(text, run[-1][1], begin)):
            close()
        if part:
            run.append((begin, end))
        else:
            nodes.append((begin, end, -1, _value(text[begin:end])))
    close()
    return nodes


def _skips(values: list[str]) -> tuple[np.ndarray, int]:
    """Edges from like nodes to the node of their value, which come after the others, and the number of value nodes.

    One edge per occurrence; the nodes of long values with one short suffix meet in the node of that suffix.
    """
    members: dict[tuple[str, int], list] = {}
    for n, value in enumerate(values):
        if value.isdigit() and len(value) >= _ALIKE_DIGITS:
            size = _LONG_DIGITS if len(value) >= _LONG_DIGITS else _ALIKE_DIGITS
            members.setdefault((value[-size:], size), []).append(n)
        elif len(value) >= _ALIKE_DIGITS:
            members.setdefault((value, 0), []).append(n)
    for value, size in [key for key in members if key[1] == _LONG_DIGITS]:
        members.setdefault((value[-_ALIKE_DIGITS:], _ALIKE_DIGITS), []).append((value, size))
    # A value node with one member only passes it on.
    short = [key for key, own in members.items() if key[1] == _ALIKE_DIGITS and len(own) > 1]
    above = {own for key in short for own in members[key] if isinstance(own, tuple)}
    kept = [key for key, own in members.items() if key[1] != _ALIKE_DIGITS and (len(own) > 1 or key in above)] + short
    place = {key: len(values) + n for n, key in enumerate(kept)}
    edges = [(place[own] if isinstance(own, tuple) else own, place[key]) for key in kept for own in members[key]]
    return np.array(edges, int).reshape(-1, 2), len(kept)


@dataclass
class Graph:
    """Nodes of a document that can carry a label, the nodes of repeated values after them, and the edges between them.

    Nodes of values have no features and the place (-1, -1).
    """

    places: list[tuple[int, int]]
    features: np.ndarray
    known: np.ndarray  # label of tokens inside base spans, -1 for others
    chain: np.ndarray
    skip: np.ndarray


def graph_of(text: str, spans: list[tuple[int, int, int]]) -> Graph | None:
    nodes = _nodes(text, spans)
    if not nodes:
        return None
    skip, more = _skips([node[3] for node in nodes])
    places = [node[:2] for node in nodes] + [(-1, -1)] * more
    known = np.array([node[2] for node in nodes] + [-1] * more)
    features = np.array([_shape(text[b:e], text[b - 1:b]) for b, e, *_ in nodes] + [np.zeros(_FEATURES)] * more)
    chain = [(n, n + 1) for n in range(len(nodes) - 1) if nodes[n + 1][0] - nodes[n][1] <= 2]
    return Graph(places, features, known, np.array(chain, int).reshape(-1, 2), skip)


@dataclass
class Field:
    """Potentials: weights of the features, and tables for neighbours and for like tokens."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _observed(graph: Graph) -> np.ndarray:
    """The known labels, and for the node of a value that of most base spans with it, so that repeats cannot outvote them."""
    known = graph.known.copy()
    counts = np.zeros((len(known), LABELS), int)
    for n, value in graph.skip:
        if known[n] >= 0:
            counts[value, known[n]] += 1
            if graph.known[value] < 0:
                known[value] = counts[value].argmax()
    return known


def _taught(graph: Graph) -> np.ndarray:
    """Labels to learn from: a repeat of a known value has its label, all others that are not known are none."""
    own = graph.known.copy()
    for n, value in graph.skip:
        if own[value] < 0:
            own[value] = own[n]
    for n, value in graph.skip[::-1]:
        if own[n] < 0:
            own[n] = own[value]
    return np.maximum(own, 0)


def fit(graphs: list[Graph], steps: int = 300) -> Field:
    """A field fitted to graphs whose known labels, and those of their repeats, are true and all other tokens none.

    Features by gradient steps on their likelihood, tables from smoothed counts of label pairs. Without
    tokens every potential is flat.
    """
    if not graphs:
        return Field(np.zeros((_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS)))
    taught = [_taught(g) for g in graphs]
    real = [g.features[:, 0] > 0 for g in graphs]  # nodes of values have no features
    features = np.concatenate([g.features[r] for g, r in zip(graphs, real, strict=True)])
    labels = np.concatenate([own[r] for own, r in zip(taught, real, strict=True)])
    truth = np.eye(LABELS)[labels]
    weights = np.zeros((_FEATURES, LABELS))
    for _ in range(steps):
        scores = features @ weights
        p = np.exp(scores - scores.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        weights += 2.0 * (features.T @ (truth - p) / len(labels) - 1e-4 * weights)

    def table(edges: list[np.ndarray]) -> np.ndarray:
        counts = np.ones((LABELS, LABELS))
        for own, e in zip(taught, edges, strict=True):
            np.add.at(counts, (own[e[:, 0]], own[e[:, 1]]), 1)
        joint = (counts + counts.T) / (2 * counts.sum())
        alone = joint.sum(1)
        return np.log(joint / np.outer(alone, alone))

    # Repeats of one value are of one kind; the counts only tell how strongly.
    skip = table([g.skip for g in graphs])
    skip = np.where(np.eye(LABELS, dtype=bool), np.maximum(skip, SAME), np.minimum(skip, -SAME))
    return Field(weights, table([g.chain for g in graphs]), skip)


def beliefs(graph: Graph, field: Field, passes: int = PASSES) -> np.ndarray:
    """Label beliefs by loopy sum-product; nodes in base spans and the nodes of their values are fixed to their label."""
    node = graph.features @ field.weights
    known = _observed(graph)
    fixed = known >= 0
    node[fixed] = -1e9  # more than any number of messages
    node[fixed, known[fixed]] = 0.0
    node -= node.max(1, keepdims=True)
    edges = np.concatenate([graph.chain, graph.skip])
    if not len(edges):
        p = np.exp(node)
        return p / p.sum(1, keepdims=True)
    tables = np.concatenate([np.repeat(field.chain[None], len(graph.chain), 0), np.repeat(field.skip[None], len(graph.skip), 0)])
    source, goal = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    messages = np.zeros((len(source), LABELS))
    for _ in range(passes):
        total = node.copy()
        np.add.at(total, goal, messages)
        out = tables + (total[source] - messages[back])[:, :, None]
        top = out.max(1)
        fresh = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        fresh -= fresh.max(1, keepdims=True)
        moved = np.abs(fresh - messages).max()
        messages = 0.5 * messages + 0.5 * fresh
        if moved < SETTLED:
            break
    total = node.copy()
    np.add.at(total, goal, messages)
    p = np.exp(total - total.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(graph: Graph, field: Field, belief: float = BELIEF) -> list[tuple[int, int, int]]:
    """Nodes outside base spans that the field labels."""
    if not (graph.known < 0).any():
        return []
    p = beliefs(graph, field)
    best = p.argmax(1)
    real = np.array([place[0] >= 0 for place in graph.places])
    chosen = real & (graph.known < 0) & (best > 0) & (p.max(1) >= belief)
    return [(graph.places[n][0], int(best[n]) - 1, graph.places[n][1]) for n in np.flatnonzero(chosen)]


def _training_graphs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for text in frame["text"]:
            graph = graph_of(text, base_spans(text))
            if graph is not None:
                rows.append((graph.features.ravel().tolist(), graph.known.tolist(), graph.chain.ravel().tolist(), graph.skip.ravel().tolist()))
        yield pd.DataFrame(rows, columns=["features", "known", "chain", "skip"])


def train(documents: DataFrame, text: str = "text", sample: int = TRAINING_DOCUMENTS) -> Field:
    """A field fitted on a bounded sample; the base patterns are its teachers.

    ``sample`` distinct texts with a digit or an at sign, the first by their hash, give their tokens. Keys are
    chosen first, so only those texts are read whole; what reaches the driver is numbers per token.
    """
    rows = documents.select(whole(F.col(text)).alias("text")).filter(F.col("text").rlike("[0-9@]")).withColumn("key", text_key(F.col("text")))
    chosen = rows.select("key").distinct().orderBy("key").limit(sample)
    own = rows.join(F.broadcast(chosen), "key").dropDuplicates(["key"])  # at most ``sample`` keys
    found = own.select("text").mapInPandas(_training_graphs, "features array<double>, known array<int>, chain array<int>, skip array<int>").collect()
    edges = lambda x: np.array(x, int).reshape(-1, 2)
    graphs = [Graph([], np.array(r["features"]).reshape(-1, _FEATURES), np.array(r["known"]), edges(r["chain"]), edges(r["skip"]))
              for r in sorted(found, key=lambda r: (r["features"], r["known"]))]
    return fit(graphs)


SPAN = "struct<start:int,rank:int,kind:string,end:int,added:boolean>"


def _find(frames: Iterator[pd.DataFrame], text: str, field: Field) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = []
        for value in frame[text]:
            body = value or ""
            base = base_spans(body)
            graph = graph_of(body, base) if re.search("[0-9@]", body) else None
            more = added_spans(graph, field) if graph is not None else []
            every = [(*s, False) for s in base] + [(*s, True) for s in more]
            found.append([{"start": b, "rank": k, "kind": KINDS[k], "end": e, "added": a} for b, k, e, a in sorted(every)])
        yield pd.DataFrame({"key": frame["key"], "spans": found})


def find_personal_data(documents: DataFrame, text: str = "text", field: Field | None = None) -> DataFrame:
    """``documents`` with ``spans``, all base spans and those that the field adds, by start and then kind.

    The field's nodes are tokens with a digit or an at sign, and parts of one value joined. Those in a base span have
    its label; one that repeats another, also in other writing of the same digits, is linked with it over any distance
    by a node of their value, and messages over these links and between neighbours give a document one label for one value. Texts without such tokens
    have no spans. NULL and empty texts have none; no documents give no rows; repeated rows are alike; a column
    named ``spans`` is replaced, all others are kept. Texts are judged whole and once per row.
    """
    model = field or train(documents, text)
    plain = documents.drop("spans")
    body = plain.select(text_key(F.col(text)).alias("key"), whole(F.col(text)).alias("text")).filter(F.col("text").rlike("[0-9@]"))
    found = (body.mapInPandas(lambda frames: _find(frames, "text", model), f"key string, spans array<{SPAN}>")
             .groupBy("key").agg(F.any_value("spans").alias("spans")))
    rows = plain.withColumn("__key", text_key(plain[text]))
    joined = rows.join(found.hint("merge"), rows["__key"] == found["key"], "left")
    return joined.select(*(rows[c] for c in plain.columns), F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
