"""N-gram Jaccard join by grouped prefixes.

Documents with equal shingle sets are one set. For two sets to reach the threshold they must share a shingle among the
first ``size - ceil(threshold * size) + 1`` of each in one global order; the order is by the number of sets that hold a
shingle, rare ones first, so that a passage which a third of all documents share comes last. A shingle of a single set
can't be shared: it is counted, and left out of everything that is shuffled further. Sets with the same size and the
same shared prefix form a group; pairs of groups that meet in a prefix shingle and pass the size filter are expanded to
their members and verified on the full sets.

Only the classes of linked documents are asked for, so a first round verifies each member of a group against the group's
hub, and each group of a prefix shingle against the shingle's hub; a second round verifies every remaining pair whose
sets aren't in one class yet and whose sizes, positions and signatures allow the threshold. No link between different
classes can be missed, and copies never make pairs.

Shingles travel as packed arrays keyed by ranges of their hash, as many ranges as the number of shingles asks for. Common
shingles (a hundredth of all rows hold them) aren't counted in their range: they are the last ones of the order, and go
from the texts straight to their sets, so that no task gathers the sets of one shingle. A set is told by a 64-bit hash of
its shingles, a shingle by the range number and 48 more bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.graph import connected_components
from fieldloom.llm.scan import U64, distinct, mix, shingles, slices, text_buffer, words
from fieldloom.session import cut, shuffle_partitions

#: Shingles that a task packs at a time (20 bytes each, and as much again while they are sorted).
PACKED = 600_000
#: Shingles of a hash range on average, at most, where they outnumber the shuffle partitions' room.
RANGE_SHINGLES = 8_000_000
#: A shingle is common if this share of all rows hold it (so there are at most 100 times as many as a row has on average).
COMMON = 0.01
LAST = 0xFFFFFFFF
#: Columns of a set's signature: the parity of its shared shingles in 256 places.
SIGNATURE = ("s0", "s1", "s2", "s3")


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row of each distinct shingle, shingle) of slices of a text column."""
    data, offsets = text_buffer(column)
    for a, b in slices(offsets):
        row, word, _, _ = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        at, value = shingles(row, word, size)
        row, value = distinct(row[at], value)
        yield a, b - a, row, value


def _names(rows: int, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size, hash) of each row's set; 0 without shingles."""
    size = np.bincount(row, minlength=rows)
    total = np.zeros(len(value) + 1, U64)
    np.cumsum(mix(value ^ U64(0x5851F42D4C957F2D)), out=total[1:])
    end = np.cumsum(size)
    return size, np.where(size > 0, mix(total[end] - total[end - size] + size.astype(U64)), U64(0))


def set_table(docs: DataFrame, size: int, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, entity, shingle): size and hash of each row's shingle set; entity is null for empty sets.

    Rows with a shingle are no sets: they say that ``n`` texts of a buffer hold a shingle which is frequent there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = texts = 0

        def frequent() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(4, COMMON / 2 * texts)
            nothing = pa.nulls(int(often.sum()), pa.int64())
            return pa.RecordBatch.from_arrays(
                [nothing, pa.array(n[often], pa.int64()), nothing, pa.array(value[often].view(np.int64))], ["doc_id", "n", "entity", "shingle"]
            )

        for batch in batches:
            for a, rows, row, value in _sets(batch.column("text"), size):
                n, name = _names(rows, row, value)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, rows), pa.array(n, pa.int64()), pa.array(name.view(np.int64), mask=n == 0), pa.nulls(rows, pa.int64())],
                    ["doc_id", "n", "entity", "shingle"],
                )
                held.append(value)
                count, texts = count + len(value), texts + rows
                if count >= PACKED:
                    yield frequent()
                    held, count, texts = [], 0, 0
        if count:
            yield frequent()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n long, entity long, shingle long"
    )


def _place(value: np.ndarray, ranges: int) -> np.ndarray:
    return ((value >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int32)


def _ids(place: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    """The number of a shingle outside its hash range: 48 bits of its hash and the range's number above them.

    With more than 65,536 ranges the number wraps: what is left tells shingles apart as a hash of 64 bits does.
    """
    return ((value & U64(0xFFFFFFFFFFFF)) + (np.asarray(place).astype(U64) << U64(48))).view(np.int64)


def _edges(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_values):
        edges = np.r_[np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), len(sorted_values)].tolist()
        yield from zip(edges[:-1], edges[1:])


def _packed(docs: DataFrame, size: int, ranges: int, common: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(range, low, counts, entities, sizes): packed shingles by hash range, sets ascending within a row.

    Common shingles have rows of their own, by range of the set hash, with as many sets as shingles and null counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            value = np.concatenate([h[0] for h in held])
            entity = np.concatenate([h[1] for h in held])
            n = np.concatenate([h[2] for h in held])
            held.clear()
            columns: list[list] = [[], [], [], [], []]
            often = np.isin(value, common)
            some, by = np.flatnonzero(often), _place(entity[often], ranges)
            some, by = some[np.argsort(by, kind="stable")], np.sort(by, kind="stable")
            for a, b in _edges(by):
                at = some[a:b]
                for column, x in zip(columns, (int(by[a]), _ids(_place(value[at], ranges), value[at]).tobytes(), None, entity[at].tobytes(), n[at].tobytes())):
                    column.append(x)
            value, entity, n = value[~often], entity[~often], n[~often]
            place = _place(value, ranges)
            order = np.lexsort((entity, place))
            place, value, entity, n = place[order], value[order], entity[order], n[order]
            for a, b in _edges(place):
                new = np.flatnonzero(np.r_[True, entity[a + 1 : b] != entity[a : b - 1]])
                columns[0].append(int(place[a]))
                columns[1].append(np.ascontiguousarray(value[a:b].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
                columns[2].append(np.diff(np.r_[new, b - a]).astype("<u4").tobytes())
                columns[3].append(entity[a:b][new].tobytes())
                columns[4].append(n[a:b][new].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                ["range", "low", "counts", "entities", "sizes"],
            )

        for batch in batches:
            for _, rows, row, value in _sets(batch.column("text"), size):
                n, name = _names(rows, row, value)
                _, first = np.unique(name, return_index=True)  # copies within the slice
                one = np.zeros(rows, bool)
                one[first] = True
                keep = one[row]
                held.append((value[keep], name[row[keep]], n[row[keep]].astype(np.uint32)))
                count += int(keep.sum())
                if count >= PACKED:
                    yield from flush()
                    count = 0
        if count:
            yield from flush()

    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(text).alias("text"))
    return rows.mapInArrow(run, "range int, low binary, counts binary, entities binary, sizes binary")


def _shared(ranges: int):
    """Of one hash range: the shingles that two or more sets hold, packed again by range of the set hash.

    Common shingles come by that range already and go on as they are.
    """

    def run(table: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        own = table.column("range")[0].as_py()
        counted = pc.is_valid(table.column("counts"))
        for row in table.filter(pc.invert(counted)).to_pylist():
            n = len(row["sizes"]) // 4
            for column, x in zip(out, (own, row["entities"], row["low"], np.full(n, LAST, "<u4").tobytes(), row["sizes"])):
                column.append(x)
        table = table.filter(counted)

        def column(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in table.column(name))])

        counts = column("counts", "<u4")
        low = np.zeros((len(six := column("low", np.uint8)) // 6, 8), np.uint8)
        low[:, :6] = six.reshape(-1, 6)
        low = low.view("<u8").reshape(-1)
        by_low = np.argsort(low, kind="stable")
        ordered = low[by_low]
        new = np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)]
        run_of = np.cumsum(new) - 1
        often = np.bincount(run_of)[run_of] > 1
        keep = np.sort(by_low[often])  # most shingles go here
        owner = np.repeat(np.arange(len(counts)), counts)[keep]
        low, entity, n = low[keep], column("entities", "<u8")[owner], column("sizes", "<u4")[owner]
        order = np.lexsort((entity, low))
        low, entity, n = low[order], entity[order], n[order]
        if len(low):
            one = np.r_[True, (low[1:] != low[:-1]) | (entity[1:] != entity[:-1])]  # copies from several tasks
            low, entity, n = low[one], entity[one], n[one]
            run_of = np.cumsum(np.r_[True, low[1:] != low[:-1]]) - 1
            df = np.bincount(run_of)[run_of]
            low, entity, n, df = low[df > 1], entity[df > 1], n[df > 1], df[df > 1]
        else:
            df = np.zeros(0, np.int64)
        place = _place(entity, ranges)
        order = np.argsort(place, kind="stable")
        for a, b in _edges(place[order]):
            some = order[a:b]
            out[0].append(int(place[some[0]]))
            out[1].append(entity[some].astype("<u8").tobytes())
            out[2].append(_ids(own, low[some]).astype("<i8").tobytes())
            out[3].append(df[some].astype("<u4").tobytes())
            out[4].append(n[some].astype("<u4").tobytes())
        return pa.table(
            [pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])],
            names=["range", "entities", "shingles", "df", "sizes"],
        )

    return run


def _candidates(percent: int):
    """Of one range of sets: those that can still reach the threshold, with their shared shingles in the global order."""

    def run(table: pa.Table) -> pa.Table:
        def column(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column(name)])

        entity, shingle, df, n = column("entities", "<u8"), column("shingles", "<i8"), column("df", "<u4"), column("sizes", "<u4").astype(np.int64)
        order = np.lexsort((shingle, df, entity))
        entity, shingle, n = entity[order], shingle[order], n[order]
        one = np.r_[True, (entity[1:] != entity[:-1]) | (shingle[1:] != shingle[:-1])]  # common ones of copies from several tasks
        entity, shingle, n = entity[one], shingle[one], n[one]
        starts = np.flatnonzero(np.r_[True, entity[1:] != entity[:-1]])
        live = np.diff(np.r_[starts, len(entity)])
        size = n[starts]
        least = -(-percent * size // 100)  # shared shingles that any partner needs
        prefix = (size - least + 1) - (size - live)  # what is left of the prefix behind the unshared shingles
        good = (live >= least) & (prefix > 0)
        rows = np.repeat(good, live)
        place = mix(shingle.astype(U64)) >> U64(56)
        signature = [
            np.bitwise_xor.reduceat(np.where(place >> U64(6) == U64(k), U64(1) << (place & U64(63)), U64(0)), starts) if len(starts) else np.zeros(0, U64)
            for k in range(4)
        ]
        offsets = np.r_[0, np.cumsum(live[good])].astype(np.int32)
        return pa.table(
            [
                pa.array(entity[starts][good].view(np.int64)),
                pa.array(size[good]),
                pa.array(prefix[good].astype(np.int32)),
                pa.array((size - live)[good].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(shingle[rows])),
                *(pa.array(x[good].view(np.int64)) for x in signature),
            ],
            names=["entity", "n", "prefix", "unshared", "shingles", *SIGNATURE],
        )

    return run


def candidate_sets(docs: DataFrame, size: int, percent: int, ranges: int, common: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(entity, n, prefix, unshared, shingles, signature): the different shingle sets that can have a partner."""
    packed = _packed(docs, size, ranges, common, doc_id, text)
    shared = packed.groupBy("range").applyInArrow(
        _shared(ranges), "range int, entities binary, shingles binary, df binary, sizes binary"
    )
    return shared.groupBy("range").applyInArrow(
        _candidates(percent),
        "entity long, n long, prefix int, unshared int, shingles array<long>, " + ", ".join(f"{c} long" for c in SIGNATURE),
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of sets whose full sets reach the threshold."""
    left = sets.select(F.col("entity").alias("a"), F.col("n").alias("an"), F.col("shingles").alias("at"))
    right = sets.select(F.col("entity").alias("b"), F.col("n").alias("bn"), F.col("shingles").alias("bt"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("at", "bt")))
    return joined.where(F.col("both") * 100 >= percent * (F.col("an") + F.col("bn") - F.col("both"))).select("a", "b")


def _may_reach(percent: int, other: str):
    """Size and position filter of two sets that meet in a shingle; a pair passes at the first shingle it shares."""
    n, n2 = F.col("n"), F.col(f"n{other}")
    sizes = F.least(n, n2) * 100 >= percent * F.greatest(n, n2)
    return sizes & (F.least(F.col("rest"), F.col(f"rest{other}")) * (100 + percent) >= percent * (n + n2))


def _signatures_allow(percent: int):
    """Places where the signatures of two sets differ, and all unshared shingles, are in one of the sets only."""
    apart = F.col("unshared") + F.col("unshared2") + sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}2"))) for c in SIGNATURE)
    both = F.col("n") + F.col("n2")
    return (both - apart) * (100 + percent) >= 2 * percent * both


def linked_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets that are linked with another one."""
    sets = cut(sets)
    prefix = F.slice("shingles", 1, F.col("prefix"))
    members = cut(sets.select("entity", "n", "unshared", *SIGNATURE, F.xxhash64("n", prefix).alias("group"), prefix.alias("head")))
    # The hub: the set with the least of its own, the likeliest original.
    hub = F.min_by("entity", F.struct("unshared", "n", "entity")).alias("hub")
    groups = cut(members.groupBy("group").agg(hub, F.min("n").alias("n"), F.min("unshared").alias("unshared"), F.first("head").alias("head")))
    heads = groups.select("group", "hub", "n", "unshared", F.posexplode("head").alias("at", "shingle"))
    # Shingles that a set has from here on in the global order: no overlap that begins here is larger.
    heads = heads.withColumn("rest", F.col("n") - F.col("unshared") - F.col("at")).drop("at")

    in_group = members.join(groups.select("group", "hub"), "group").where(F.col("entity") != F.col("hub")).select(F.col("hub").alias("a"), F.col("entity").alias("b"))
    centre = F.min_by(F.struct("hub", "n", "rest"), F.struct("unshared", "n", "hub"))
    centres = heads.groupBy("shingle").agg(centre.alias("c"), F.count("*").alias("m")).where("m > 1")
    centres = centres.select("shingle", F.col("c.hub").alias("a"), F.col("c.n").alias("n_a"), F.col("c.rest").alias("rest_a"))
    near = heads.join(centres, "shingle").where((F.col("hub") != F.col("a")) & _may_reach(percent, "_a"))
    first = in_group.unionByName(near.select("a", F.col("hub").alias("b"))).distinct()
    links = cut(_verified(first, sets, percent))
    classes = connected_components(links)

    # What may be left: pairs of sets in different classes whose groups meet in a shingle (or are one group).
    labelled = cut(
        members.join(classes.withColumnRenamed("node", "entity"), "entity", "left").select(
            "entity", "group", F.coalesce("component", "entity").alias("class"), "n", "unshared", *SIGNATURE
        )
    )
    alone = F.count("*") == 1  # a part of one set is known by its signature
    parts = labelled.groupBy("group", "class").agg(*[F.when(alone, F.first(c)).alias(c) for c in SIGNATURE])
    mixed = heads.select("shingle", "group", "n", "unshared", "rest").join(parts, "group")
    several = mixed.groupBy("shingle").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("shingle")
    mixed = cut(mixed.join(several, "shingle", "left_semi"))
    about = ("n", "unshared", *SIGNATURE)
    # Sizes that may reach the threshold are in one band or in neighbouring ones: other sets of a shingle don't meet.
    band = F.floor(F.log("n") / float(-np.log(percent / 100))) if percent < 100 else F.col("n")
    other = mixed.select("shingle", F.explode(F.array(band - 1, band, band + 1)).alias("band"), *[F.col(c).alias(f"{c}2") for c in ("group", "rest", "class", *about)])
    meet = (
        mixed.withColumn("band", band)
        .join(other, ["shingle", "band"])
        .where((F.col("class") < F.col("class2")) & _may_reach(percent, "2") & F.coalesce(_signatures_allow(percent), F.lit(True)))
        .select("group", "class", "group2", "class2")
        .distinct()
    )
    one = labelled.select("group", "class", F.col("entity").alias("a"), *about)
    two = labelled.select(F.col("entity").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("group", "class", *about)])
    rest = meet.join(one, ["group", "class"]).join(two, ["group2", "class2"]).where(_signatures_allow(percent)).select("a", "b").distinct()
    more = cut(_verified(rest, sets, percent))
    if more.isEmpty():
        return classes
    return connected_components(links.unionByName(more))


def ngram_components(
    docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``, A-Z in lower case; a set holds the distinct runs of ``size``
    words, or the whole sequence where there are fewer. Rows link if 100 * |intersection| >= ``percent`` * |union|;
    ``component_id`` is the smallest id that links reach. Rows without words have 0 shingles and are linked with
    nothing; rows with a null id keep a null component. Rows with one id and different texts link all they link with.
    """
    table = cut(set_table(docs, size, doc_id, text))
    frequent = table.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
    table = table.where("shingle is null").drop("shingle")
    rows, total = table.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = max(shuffle_partitions(docs.sparkSession), -(-total // RANGE_SHINGLES))
    common = frequent.where(F.col("n") >= max(8, COMMON * rows)).select("shingle").collect()  # at most total / (COMMON * rows)
    common = np.array([r["shingle"] for r in common], np.int64).view(U64)
    classes = linked_sets(candidate_sets(docs, size, percent, ranges, common, doc_id, text), percent)
    present = table.where("entity is not null and doc_id is not null")
    named = present.groupBy("entity").agg(F.min("doc_id").alias("first"))
    named = cut(named.join(classes.withColumnRenamed("node", "entity"), "entity", "left").withColumn("class", F.coalesce("component", "entity")))
    least = named.groupBy("class").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "class").select("entity", "component_id")
    linked = table.where("entity is not null").join(labels, "entity", "left")
    alone = table.where("entity is null").withColumn("component_id", F.col("doc_id"))
    return linked.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    ).unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), "component_id"))
