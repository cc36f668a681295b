"""Near-duplicate join on word shingles: partitioned universe, pigeonhole signatures, exact verification."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.storage import stored
from tallyloom.llm.words import whole

#: Words of a shingle and percent of the union that two documents must share, as the library has them by default.
SHINGLE_WORDS, PERCENT = 5, 80
#: Shingles are counted in this many classes per task; a class is common when it is in this share of a task's documents.
COUNT_CLASSES = 1 << 22
COMMON_SHARE = 0.002
FEWEST_COMMON = 16
#: Bytes of a text whose words are hashed at once.
BLOCK_BYTES = 1 << 16
#: Words of 64 bits that hold a set's parities.
PARITY_WORDS = 8
PARITIES = [f"p{n}" for n in range(PARITY_WORDS)]
#: Members that are verified against one copy of their leader.
LEADER_MEMBERS = 256
#: Most keys of 8 bytes that are sent to every executor, which holds them in about 100 MB; more are joined by shuffle.
SENT_KEYS = 1 << 21
#: Most rows of pairs, links or sizes, of up to 100 bytes each, that are sent to every executor; more are joined by shuffle.
SENT_ROWS = 1 << 17
_WORD = r"[^\x20\x09-\x0D]"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64((1 << 26) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seed(n: int) -> np.uint64:
    return np.uint64(n * int(_MIX) & (2**64 - 1))


def _powers(base: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK_BYTES, base, np.uint64)]))


#: A word's hash is the sum of its bytes' numbers times powers of an odd base, which is found from running sums.
_BASE = 0xD1342543DE82EF95
_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
_NUMBERS = _mixed(np.arange(1, 257, dtype=np.uint64) * _MIX)
_IN_WORD = np.array([n != 32 and not 9 <= n <= 13 for n in range(256)])


def word_hashes(data: bytes, block_bytes: int = BLOCK_BYTES) -> np.ndarray:
    """64-bit hashes of the words between ASCII blanks, in order.

    Bytes are read in blocks, since each takes several numbers; a word that a block cuts goes on in the next one.
    """
    out, open_hash, open_length = [np.empty(0, np.uint64)], 0, 0
    for at in range(0, len(data), block_bytes):
        block = np.frombuffer(data, np.uint8, min(block_bytes, len(data) - at), at)
        inside = np.zeros(block.size + 2, bool)
        inside[1:-1] = _IN_WORD[block]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(block.size + 1, np.uint64)
        np.cumsum(_NUMBERS[block] * _POWERS[:block.size], out=sums[1:])
        found = (sums[ends] - sums[starts]) * _INVERSES[starts]
        before = open_length if inside[1] else 0
        if before:
            found[0] = (open_hash + pow(_BASE, before, 1 << 64) * int(found[0])) % (1 << 64)
        elif open_length:
            out.append(np.array([open_hash], np.uint64))
        open_length = 0
        if inside[-2]:
            open_hash, open_length = int(found[-1]), int(ends[-1] - starts[-1]) + (before if starts.size == 1 else 0)
            found = found[:-1]
        out.append(found)
    if open_length:
        out.append(np.array([open_hash], np.uint64))
    return _mixed(np.concatenate(out))


def shingle_set(text: str | None, length: int) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted; a shorter text is one shingle, an empty one none.

    Words stand between ASCII blanks, A-Z in lower case, which is how ``bytes`` lowers.
    """
    hashed = word_hashes((text or "").encode().lower())
    if not hashed.size:
        return hashed
    width = min(length, hashed.size)
    out = np.full(hashed.size - width + 1, width, np.uint64)
    for n in range(width):
        out = (out ^ hashed[n:hashed.size - width + 1 + n]) * _MIX
        out ^= out >> np.uint64(29)
    out = np.sort(_mixed(out))
    first = np.empty(out.size, bool)
    first[0] = True
    np.not_equal(out[1:], out[:-1], out=first[1:])
    return out[first]


class Bands:
    """Size bands and, per band, how many segments two similar sets may differ in.

    Bands grow by the similarity, so that partners are in one band or in neighbouring ones. Group ``p`` holds pairs
    whose smaller set is in band ``p``; a set takes part in the group of its own band and of the band below.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.limits = [1]

    def _reach(self, size: int, groups: int = 0) -> None:
        while self.limits[-1] <= size or len(self.limits) < groups:
            self.limits.append(self.limits[-1] * 100 // self.percent + 1)

    def band(self, size: int) -> int:
        self._reach(size)
        return bisect_right(self.limits, size) - 1

    def difference(self, group: int) -> int:
        """Most elements that are in only one of two linked sets of the group."""
        self._reach(0, group + 2)
        small = self.limits[group + 1] - 1
        return (small + small * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)


def parities(items: np.ndarray) -> np.ndarray:
    """For each of 64 times ``PARITY_WORDS`` classes whether the set has an odd number of elements in it.

    An element in only one of two sets changes one parity, so sets differ in at least as many elements as parities.
    """
    n = 64 * PARITY_WORDS
    odd = np.bincount(((items >> np.uint64(17)) % np.uint64(n)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _classes(items: np.ndarray) -> np.ndarray:
    return (items % np.uint64(COUNT_CLASSES)).astype(np.int64)


def signatures(items: np.ndarray, group: int, difference: int, common: np.ndarray) -> np.ndarray:
    """Hashes of ``difference + 1`` segments of the set; ``common`` are the classes of common shingles, in order.

    The universe is dealt into ``difference + 1 + spare`` segments. Linked sets differ in at most ``difference`` of
    them, so they agree on ``spare + 1`` at least. Both leave out their ``spare`` most costly segments, in one order
    that depends on a segment's content only: the cheapest segment they agree on has ``spare`` such segments above it
    and so is left out by neither. Costly are segments with few rare shingles: many unlike sets agree on them.
    """
    spare = 0 if difference == 0 else 1 + difference // 8
    n = difference + 1 + spare
    salted = _mixed(items + _seed(group + 1))
    segment = (((salted >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)
    # Sums of 26 bits each are exact as floating point numbers for sets of up to 2 ** 27 shingles.
    low, high = (np.bincount(segment, weights=part.astype(float), minlength=n).astype(np.uint64)
                 for part in (salted & _HALF, (salted >> np.uint64(26)) & _HALF))
    hashed = _mixed((high << np.uint64(26)) + low + np.arange(1, n + 1, dtype=np.uint64) * _MIX + _seed(-1 - group))
    if not spare:
        return hashed
    total = np.bincount(segment, minlength=n)
    rare = total
    if common.size:
        classes = _classes(items)
        place = np.minimum(np.searchsorted(common, classes), common.size - 1)
        rare = np.bincount(segment[common[place] != classes], minlength=n)
    return hashed[np.lexsort((hashed, total, rare))[spare:]]


def _groups(bands: Bands, size: int) -> list[tuple[int, int]]:
    """Groups a set of this size takes part in, with their differences."""
    own = bands.band(size)
    return [(g, bands.difference(g)) for g in (own, own - 1) if g >= 0]


def _once(frame: pd.DataFrame) -> pd.DataFrame:
    """Copies of a text inside a batch as one row with their number."""
    return frame.groupby(["hi", "lo"], sort=False).agg(text=("text", "first"), copies=("text", "size")).reset_index()


def _sizes(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """A row with the set size of every text, and at the end of a task a row per common class of shingles."""
    counts, documents = np.zeros(COUNT_CLASSES, np.int64), 0
    waiting, n_waiting = [], 0
    for frame in frames:
        own = _once(frame)
        sizes, odd = [], np.zeros((len(own), PARITY_WORDS), np.int64)
        for n, (text, copies) in enumerate(zip(own["text"], own["copies"], strict=True)):
            items = shingle_set(text, length)
            sizes.append(len(items))
            odd[n] = parities(items)
            classes = _classes(items)
            if copies > 1:
                np.add.at(counts, classes, copies - 1)
            waiting.append(classes)
            n_waiting += classes.size
            # Counting many sets at once costs a pass over the counters.
            if n_waiting > COUNT_CLASSES:
                counts += np.bincount(np.concatenate(waiting), minlength=COUNT_CLASSES)
                waiting, n_waiting = [], 0
        documents += len(frame)
        yield pd.DataFrame({"hi": own["hi"], "lo": own["lo"], "n_shingles": sizes, "class": -1, "n": 0, **dict(zip(PARITIES, odd.T, strict=True))})
    if waiting:
        counts += np.bincount(np.concatenate(waiting), minlength=COUNT_CLASSES)
    common = np.flatnonzero(counts >= max(FEWEST_COMMON, int(COMMON_SHARE * documents)))
    if common.size:
        yield pd.DataFrame({"hi": 0, "lo": 0, "n_shingles": 0, "class": common, "n": counts[common], **dict.fromkeys(PARITIES, 0)})


def _emit(frames: Iterator[pd.DataFrame], length: int, percent: int, common: np.ndarray) -> Iterator[pd.DataFrame]:
    """Rows (sig, hi, copies) of every text."""
    bands = Bands(percent)
    for frame in frames:
        parts, columns = [], []
        for row in _once(frame).itertuples(index=False):
            items = shingle_set(row.text, length)
            if not len(items):
                continue
            found = np.concatenate([signatures(items, g, difference, common) for g, difference in _groups(bands, len(items))])
            parts.append(found)
            columns.append((row.hi, row.copies, len(found)))
        if parts:
            hi, copies, n = (np.array(c, np.int64) for c in zip(*columns, strict=True))
            yield pd.DataFrame({"sig": np.concatenate(parts).view(np.int64), "hi": np.repeat(hi, n), "copies": np.repeat(copies, n).astype(np.int32)})


def _verified(frames: Iterator[pd.DataFrame], length: int, percent: int) -> Iterator[pd.DataFrame]:
    """Links of rows that are ordered so that a leader's text comes before those of its members."""
    leader, own = None, np.empty(0, np.uint64)
    for frame in frames:
        rows = []
        for row in frame.itertuples(index=False):
            key = (row.a_hi, row.a_lo)
            if row.member == 0:
                if key != leader:
                    leader, own = key, shingle_set(row.text, length)
                continue
            other = shingle_set(row.text, length)
            shared = np.intersect1d(own, other, assume_unique=True).size
            if 100 * shared >= percent * (own.size + other.size - shared):
                rows.append((row.a_hi, row.a_lo, row.hi, row.lo))
        if rows:
            yield pd.DataFrame(rows, columns=["a_hi", "a_lo", "hi", "lo"])


_IDS = "a_hi long, a_lo long, hi long, lo long"


def identified(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, text, hi, lo): the text, NULL as empty, and two 64-bit hashes that name it."""
    body = whole(F.col(text))
    return documents.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("hi"),
                            F.xxhash64(F.lit("second"), body).alias("lo"))


def _sent(rows: DataFrame, n: int) -> DataFrame:
    """The rows, of which there are at most ``n``: up to ``SENT_ROWS`` go to the other side of a join, more are shuffled with it."""
    return F.broadcast(rows) if n <= SENT_ROWS else rows


def verify(pairs: DataFrame, bodies: DataFrame, length: int, percent: int) -> DataFrame:
    """The linked ones of the stored pairs (a_hi, a_lo, hi, lo).

    Members of one leader are dealt out in parts of about ``LEADER_MEMBERS``, each with a copy of the leader's
    text, so that no task gets more than a part of a large group at once.
    """
    n_pairs = pairs.count()
    parts = F.ceil(F.col("n") / LEADER_MEMBERS).cast("int")
    leaders = _sent(pairs.groupBy("a_hi", "a_lo").agg(F.count("*").alias("n")).withColumn("parts", parts).drop("n"), n_pairs)
    names = bodies.select(F.col("hi").alias("a_hi"), F.col("lo").alias("a_lo"), "text")
    heads = names.join(leaders, ["a_hi", "a_lo"]).select("a_hi", "a_lo", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                                                         F.lit(0).alias("member"), F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo"), "text")
    part = F.pmod(F.xxhash64("hi", "lo"), F.col("parts")).cast("int")
    dealt_out = pairs.join(leaders, ["a_hi", "a_lo"]).withColumn("part", part)
    members = (bodies.join(_sent(dealt_out, n_pairs), ["hi", "lo"])
               .select("a_hi", "a_lo", "part", F.lit(1).alias("member"), "hi", "lo", "text"))
    dealt = heads.unionByName(members).repartition("a_hi", "a_lo", "part")
    ordered = dealt.sortWithinPartitions("a_hi", "a_lo", "part", "member")
    return ordered.mapInPandas(lambda frames: _verified(frames, length, percent), _IDS)


def connected(links: DataFrame) -> DataFrame:
    """Rows (node, label) for links (a, b): the smallest node that is reachable. Each round is a stored table.

    Every node takes the smallest label around it, and then its label's label, until nothing changes.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "links")
    n_links = both.count()  # no fewer than nodes
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        around = _sent(labels, n_links)
        near = both.join(around, both["b"] == around["node"]).groupBy("a").agg(F.min("label").alias("near"))
        old = _sent(labels.withColumnRenamed("label", "old"), n_links)
        taken = near.join(old, old["node"] == near["a"]).select("node", "old", F.least("old", "near").alias("label"))
        roots = _sent(labels.select(F.col("node").alias("root"), F.col("label").alias("root_label")), n_links)
        new = stored(taken.join(roots, taken["label"] == roots["root"], "left").select(
            "node", "old", F.least("label", F.coalesce("root_label", "label")).alias("label")), "labels")
        changed = new.filter("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


def _pair_links(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.struct(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).alias("a"), F.struct("hi", "lo").alias("b"))


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether the parities leave room for a link; true for every linked pair."""
    differ = sum((F.bit_count(F.col(f"{a}.{p}").bitwiseXOR(F.col(f"{b}.{p}"))) for p in PARITIES), F.lit(0))
    return differ * (100 + percent) <= (F.col(f"{a}.n_shingles") + F.col(f"{b}.n_shingles")) * (100 - percent)


def _groups_of_leaders(rows: DataFrame, n_leaders: int) -> DataFrame:
    """Rows (key, merged, node, label): what to compare with each other, for stored rows (sig, a_hi, node, label).

    Near copies share many signatures, most of them with one leader. The signatures of a leader are merged into one
    group where that makes no more pairs than they have one by one. Every pair of a signature is in a group.
    """
    apart = rows.groupBy("a_hi", "sig").agg(F.count("*").cast("double").alias("n")).groupBy("a_hi").agg(F.sum(F.col("n") * F.col("n")).alias("apart"))
    together = rows.select("a_hi", "node").distinct().groupBy("a_hi").agg(F.count("*").cast("double").alias("n"))
    merged = together.join(apart, "a_hi").select("a_hi", (F.col("n") * F.col("n") <= F.col("apart")).alias("merged"))
    keyed = rows.join(_sent(merged, n_leaders), "a_hi")
    return keyed.select(F.when(F.col("merged"), F.col("a_hi")).otherwise(F.col("sig")).alias("key"), "merged", "node", "label").distinct()


def linked_texts(texts: DataFrame, sizes: DataFrame, length: int, percent: int, common: np.ndarray) -> DataFrame:
    """Rows (node, label) of all texts that are linked with another one, for texts (hi, lo, text) and their sizes.

    Texts that share a signature are candidates. Per signature, one of them, the one with most copies, is compared
    with the others; what is linked by that needs no further comparison inside its component. Then texts of one
    signature that are still in different components are compared, which a signature of two texts never needs; texts
    that share many signatures are compared once for their leader instead of once for each. Before a text is read
    again, the parities of both sets have to allow a link.

    Signature rows name a text by its first hash only. All texts with that hash are candidates then; two texts that share
    it and no signature with a third one are not compared (a chance of 2 ** -64 for each linked pair).
    """
    rows = texts.select("text", "hi", "lo").mapInPandas(
        lambda frames: _emit(frames, length, percent, common), "sig long, hi long, copies int")
    group = Window.partitionBy("sig")
    rows = rows.withColumn("a_hi", F.max(F.struct("copies", "hi")).over(group)["hi"])
    other = F.when(F.col("hi") != F.col("a_hi"), F.col("hi"))
    rows = rows.withColumns({"low": F.min(other).over(group), "high": F.max(other).over(group)}).filter("low is not null")
    members = stored(rows.select("sig", "hi", "a_hi", (F.col("low") != F.col("high")).alias("wide")).distinct(), "members")
    info = stored(sizes.join(members.select("hi").distinct(), "hi", "left_semi"), "infos")
    n_info = info.count()
    stars = members.filter("hi <> a_hi").select("a_hi", "hi").distinct()
    stars = (stars.alias("s").join(_sent(info, n_info).alias("b"), F.expr("s.hi = b.hi")).join(_sent(info, n_info).alias("a"), F.expr("s.a_hi = a.hi"))
             .filter(_may_link("a", "b", percent)).selectExpr("a.hi a_hi", "a.lo a_lo", "b.hi", "b.lo"))
    stars = stored(stars, "pairs")
    links = stored(_pair_links(verify(stars, _bodies(texts, stars), length, percent)), "links")
    node = F.struct("hi", "lo")
    nodes = info.select("hi", node.alias("node")).join(_sent(connected(links), n_info), "node", "left")
    nodes = stored(nodes.select("hi", "node", F.coalesce("label", "node").alias("label")), "nodes")
    placed = members.filter("wide").select("sig", "a_hi", "hi").join(_sent(nodes, n_info), "hi").select("sig", "a_hi", "node", "label")
    left = placed.withColumns({"low": F.min("label").over(group), "high": F.max("label").over(group)}).filter("low <> high")
    left = _groups_of_leaders(stored(left.select("sig", "a_hi", "node", "label"), "left"), n_info)
    sent = _sent(info, n_info)
    left = left.join(sent, (F.col("node.hi") == sent["hi"]) & (F.col("node.lo") == sent["lo"])).select("key", "merged", "node", "label", "n_shingles", *PARITIES)
    left = stored(left, "open")
    same = F.expr("a.key = b.key and a.merged = b.merged and a.node < b.node and a.label <> b.label")
    rest = left.alias("a").join(left.alias("b"), same & _may_link("a", "b", percent))
    rest = rest.select(F.col("a.node.hi").alias("a_hi"), F.col("a.node.lo").alias("a_lo"), F.col("b.node.hi").alias("hi"),
                       F.col("b.node.lo").alias("lo")).distinct()
    known = _sent(stars.union(stars.select("hi", "lo", "a_hi", "a_lo")), 2 * stars.count())
    rest = stored(rest.join(known, ["a_hi", "a_lo", "hi", "lo"], "left_anti"), "pairs")
    if rest.isEmpty():
        return nodes.select("node", "label")
    # Only the components of the first comparison are joined further: a link is one between their labels.
    more = _pair_links(verify(rest, _bodies(texts, rest), length, percent)).alias("m")
    own = lambda side: _sent(nodes.select(F.col("node").alias(f"{side}_node"), F.col("label").alias(f"{side}_label")), n_info)
    more = more.join(own("a"), F.expr("m.a = a_node")).join(own("b"), F.expr("m.b = b_node"))
    merged = connected(more.select(F.col("a_label").alias("a"), F.col("b_label").alias("b")))
    merged = _sent(merged.select(F.col("node").alias("old"), F.col("label").alias("merged")), n_info)
    return nodes.join(merged, F.col("label") == F.col("old"), "left").select("node", F.coalesce("merged", "label").alias("label"))


def _few_keys(keys: DataFrame) -> DataFrame:
    """Keys (hi), stored and counted: up to ``SENT_KEYS`` go to the texts, for more the texts are shuffled to the keys."""
    kept = stored(keys.select("hi").distinct(), "keys")
    return F.broadcast(kept) if kept.count() <= SENT_KEYS else kept


def _bodies(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts that the stored pairs name, each once, and any that share the first hash of one of them."""
    named = pairs.select("hi").union(pairs.select("a_hi"))
    named = F.broadcast(named.distinct()) if pairs.count() <= SENT_ROWS else _few_keys(named)
    return stored(texts.join(named, "hi", "left_semi").groupBy("hi", "lo").agg(F.any_value("text").alias("text")), "bodies")


def components(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = SHINGLE_WORDS,
               percent: int = PERCENT) -> DataFrame:
    """One stored row (doc_id, hi, lo, n_shingles, label) per document; linked documents have one label."""
    texts = identified(documents, doc_id, text)
    sized = stored(texts.select("text", "hi", "lo").mapInPandas(
        lambda frames: _sizes(frames, length), "hi long, lo long, n_shingles long, class long, n long, " + ", ".join(f"{p} long" for p in PARITIES)), "sizes")
    # A class is common in some task, so there are at most a mean set size over COMMON_SHARE of them per task; they
    # order the work and change no result.
    found = sized.filter("class >= 0").select("class").distinct().toPandas()["class"]
    common = np.sort(found.to_numpy(dtype=np.int64))
    sizes = sized.filter("class < 0").select("hi", "lo", "n_shingles", *PARITIES).distinct()
    labels = linked_texts(texts, sizes, length, percent, common)
    rows = texts.select("doc_id", "hi", "lo").join(sizes.select("hi", "lo", "n_shingles"), ["hi", "lo"]).withColumn("node", F.struct("hi", "lo"))
    rows = rows.join(labels, "node", "left")
    return stored(rows.select("doc_id", "hi", "lo", "n_shingles", F.coalesce("label", "node").alias("label")), "components")


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = SHINGLE_WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """One row per document: (doc_id, n_shingles, component_id), the smallest id reachable by links.

    Two documents link when their sets of shingles share ``percent`` of their union. Equal texts are one text until
    the end. NULL and empty texts and texts without words have no shingles and link with nothing: each is a
    component of its own. Repeated rows are linked copies; a NULL id never names a component unless all
    its ids are NULL; no documents give no rows. Sets are of 64-bit hashes. Only the named columns are read.
    """
    rows = components(documents, doc_id, text, length, percent)
    least = rows.filter("n_shingles > 0").groupBy(F.col("label").alias("own")).agg(F.min("doc_id").alias("least"))
    keyed = rows.withColumn("key", F.when(F.col("n_shingles") > 0, F.col("label")))
    joined = keyed.join(least, F.col("key") == F.col("own"), "left")
    named = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", named.alias("component_id"))


def one_of_each(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``documents`` with one row left of each component: the one with the smallest id (NULLs last), then text hash.

    Documents without words are components of their own and all stay. Of rows with one id and one text one stays.
    Rows of components with one row are passed on as they are; only the others are joined with what was chosen.
    """
    rows = components(documents, doc_id, text, **options).filter("n_shingles > 0")
    several = rows.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1").select("label")
    touched = _few_keys(rows.join(several, "label", "left_semi"))
    rows = rows.join(touched, "hi", "left_semi")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hi", "lo"))
    chosen = rows.groupBy("label").agg(first.alias("w")).select("w.doc_id", "w.hi", "w.lo")
    counts = rows.groupBy("doc_id", "hi", "lo").agg(F.count("*").alias("copies"))
    same = lambda a, b: (a["hi"] == b["hi"]) & (a["lo"] == b["lo"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    counted = chosen.join(counts, same(chosen, counts)).select(chosen["doc_id"], chosen["hi"], chosen["lo"], "copies")
    winners = stored(counted, "winners").select(F.col("doc_id").alias("w_id"), F.col("hi").alias("w_hi"), F.col("lo").alias("w_lo"), "copies")
    winners = _sent(winners, winners.count())
    names = documents.columns
    body = whole(F.col(text))
    held = documents.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), F.col(doc_id).alias("k_id"),
                            F.xxhash64(body).alias("k_hi"), F.xxhash64(F.lit("second"), body).alias("k_lo"), body.rlike(_WORD).alias("words"))
    inside = held["k_hi"] == touched["hi"]
    # A text without words gets here only if it shares the first hash of another one; it stays.
    met = F.col("words") & F.col("k_id").eqNullSafe(F.col("w_id")) & (F.col("k_hi") == F.col("w_hi")) & (F.col("k_lo") == F.col("w_lo"))
    joined = held.join(touched, inside, "left_semi").join(winners, met, "left").filter("copies is not null or not words")
    once = joined.filter("copies is null or copies = 1").select("row")
    repeated = joined.filter("copies > 1").groupBy("k_id", "k_hi", "k_lo").agg(F.any_value("row").alias("row")).select("row")
    left = held.join(touched, inside, "left_anti").select("row").union(once).union(repeated)
    return left.select(*(F.col("row").getField(n).alias(n) for n in names))
