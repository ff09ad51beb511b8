"""The graph over chunks: shared-key edges, similarity edges, spine, components, clusters, walks."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_keys, plain_name, plain_words
from ..session import cut, ranked, staged
from .pairing import meetings, similar_sets


def keys_of(values: Column) -> Column:
    """Distinct comparison keys of an array of names, in the JVM: lower case, trimmed, inner blanks reduced to one."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))), lambda x: x.isNotNull() & (x != "")))


def nodes_with_keys(nodes: DataFrame, column: str, key: str = "node_id") -> DataFrame:
    """(id, keys), repeated rows once; a node with several rows has the keys of all of them."""
    rows = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.explode(keys_of(F.coalesce(F.col(column), F.array().cast("array<string>")))).alias("k"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("k")).alias("keys"))


def shared_key_edges(keyed: DataFrame) -> DataFrame:
    """(src, dst, weight): pairs of nodes that share at least two keys, weight the number of shared keys.

    Nodes meet under pairs of keys, so that one hub key alone brings no two nodes together; w shared keys are w (w - 1) / 2
    shared pairs, from which the weight is read without fetching the keys again.
    """
    two = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.xxhash64(x, y))))
    met = meetings(keyed.where(F.size("keys") >= 2).select("id", F.explode(two).alias("token")))
    one = met.groupBy(F.col("id").alias("src"), F.col("o_id").alias("dst")).agg(F.count("*").alias("c"))
    return one.select("src", "dst", F.round((1 + F.sqrt(1 + 8 * F.col("c"))) / 2).cast("bigint").alias("weight"))


def jaccard_edges(keyed: DataFrame, threshold: float) -> DataFrame:
    """(src, dst, weight): pairs whose key sets reach the threshold; weight rounded to four digits."""
    sets = staged(keyed.select("id", F.array_sort(F.transform("keys", lambda k: F.xxhash64(k))).alias("set")), "key-sets")
    pairs = similar_sets(sets, threshold)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.bround(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 4).alias("weight"))


def spine_edges(chunks: DataFrame) -> DataFrame:
    """(src, dst, weight): consecutive chunks of a file."""
    rows = chunks.select("file", "chunk_no", "chunk_id").where("chunk_id IS NOT NULL").distinct()
    before = F.lag("chunk_id").over(Window.partitionBy("file").orderBy("chunk_no", "chunk_id"))
    return rows.select(before.alias("src"), F.col("chunk_id").alias("dst"), F.lit(1.0).alias("weight")).where("src IS NOT NULL")


def components(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component): the least id of the connected component; nodes without edges are their own.

    Alternating large-star and small-star steps on the edge list: its diameter shrinks with every round, no node's neighbours
    are gathered, and each round ends in the shared checkpoint folder. It ends when nothing changes, and with an error where
    `rounds` aren't enough.
    """
    e = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    done, mark = 0, None
    while True:
        if done == rounds:
            raise RuntimeError(f"components change after {rounds} rounds")
        done += 1
        # large star: every larger neighbour is linked to the least one
        both = e.select("u", "v").union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every smaller neighbour, and the node itself, to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small)
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if now == mark:  # the same edges, by their number and the sum of their hashes
            break
        mark = now
    return nodes.select("id").distinct().join(e.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("component"))


def importance(share: Column) -> Column:
    """Five classes of a cluster's share of all chunks."""
    return F.when(share >= 0.30, 5).when(share >= 0.18, 4).when(share >= 0.09, 3).when(share >= 0.03, 2).otherwise(1)


def cluster_sizes(members: DataFrame) -> DataFrame:
    """(cluster, size, importance, place) by size, then name; members is (cluster, id)."""
    n = members.groupBy("cluster").agg(F.countDistinct("id").alias("size"))
    total = n.agg(F.sum("size").alias("total"))
    out = n.crossJoin(F.broadcast(total)).withColumn("importance", importance(F.col("size") / F.col("total")))
    return out.select("cluster", "size", "importance")


def cluster_signature(values: DataFrame, k: int = 8) -> DataFrame:
    """(cluster, place, canonical, display, n): the k most frequent names of each cluster; values is (cluster, id, pos, name).

    The name shown is the first that came; ties go to the name that came first.
    """
    canonical = F.trim(F.regexp_replace(F.lower("name"), r"\s+", " "))
    rows = values.where("name IS NOT NULL").withColumn("canonical", canonical).where("canonical <> ''")
    g = rows.groupBy("cluster", "canonical").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos", "name")).alias("first"))
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "first.id", "first.pos", "canonical")
    return g.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("cluster", F.col("place").cast("bigint").alias("place"), "canonical", F.col("first.name").alias("display"), "n")


def built_edges(nodes: DataFrame, chunks: DataFrame, threshold: float = 0.3, key: str = "chunk_id", least: float = 0.0) -> DataFrame:
    """(src, dst, type, weight): shared_entity (two shared names at least, weight their number), keyphrase_overlap (Jaccard of
    the key phrases), same_document (consecutive chunks of a file).

    One shared name alone is no edge: a name that a third of all nodes have would link all of these with each other, and edges
    below a weight of two take no part in clustering. Where only edges of a weight of `least` are wanted, and that is above 1, the
    other two kinds, whose weights are at most 1, aren't made.
    """
    entity = shared_key_edges(nodes_with_keys(nodes, "entities", key)).select("src", "dst", F.lit("shared_entity").alias("type"), F.col("weight").cast("double").alias("weight"))
    if least > 1:
        return entity.where(F.col("weight") >= least)
    phrase = jaccard_edges(nodes_with_keys(nodes, "keyphrases", key), threshold).select("src", "dst", F.lit("keyphrase_overlap").alias("type"), "weight")
    return entity.unionByName(phrase).unionByName(spine_edges(chunks).select("src", "dst", F.lit("same_document").alias("type"), "weight"))


def clustering_edges(edges: DataFrame, least: float = 2.0) -> DataFrame:
    """The edges that may put two nodes into one cluster: those of meaning, and of some weight."""
    return edges.where((F.col("type") != "same_document") & (F.col("weight") >= least))


def split_oversized(members: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    """members (id, origin) with part, the least id of the part: clusters of at most limit nodes have one part (null).

    A larger cluster falls apart first along its components, then by leaving out its lightest edges, one weight after the
    other, as long as a part is too large and has edges. All clusters are parted together, a round for each weight that is left;
    a cluster without inner edges stays whole.
    """
    state = staged(members.select("id", "origin", F.lit(None).cast(dict(members.dtypes)["id"]).alias("part")), "cluster-state")
    inner = edges.select("src", "dst", "weight")
    first = True
    while True:
        size = state.groupBy("origin", "part").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("origin", "part")
        large = state.join(size, [state["origin"] == size["origin"], state["part"].eqNullSafe(size["part"])], "left_semi")
        ends = lambda side, large=large: large.select(F.col("id").alias(side), F.col("origin").alias(f"o_{side}"), F.col("part").alias(f"p_{side}"))
        inner = inner.join(ends("src"), "src").join(ends("dst"), "dst").where((F.col("o_src") == F.col("o_dst")) & F.col("p_src").eqNullSafe(F.col("p_dst")))
        inner = staged(inner.select("src", "dst", "weight", F.col("o_src").alias("origin"), F.col("p_src").alias("part")), "cluster-edges")
        mine = staged(inner.groupBy("origin", "part").agg(F.min("weight").alias("bar")), "cluster-bars")
        if not mine.limit(1).count():
            return state
        at = lambda df, mine=mine: [df["origin"] == mine["origin"], df["part"].eqNullSafe(mine["part"])]
        kept = inner if first else inner.join(mine, at(inner)).where(inner["weight"] > mine["bar"]).select(inner["src"], inner["dst"], inner["weight"], inner["origin"], inner["part"])
        moving = state.join(mine, at(state), "left_semi")
        parts = components(moving.select("id"), kept).select("id", F.col("component").alias("new"))
        state = staged(state.join(parts, "id", "left").select("id", "origin", F.coalesce("new", "part").alias("part")), "cluster-state")
        inner, first = kept.select("src", "dst", "weight"), False


def _next_fit(sizes: list[tuple[int, int]], limit: int) -> list[tuple[int, int, int, int]]:
    """(size, first bucket, how many it still takes, how many a new bucket takes) for clusters given as (size, number), largest
    first, that go into one bucket after the other; a bucket is closed when the next doesn't fit."""
    out, bucket, held = [], -1, limit + 1
    for size, n in sizes:
        fits = max(0, (limit - held) // size) if bucket >= 0 else 0
        fits, each = min(fits, n), max(1, limit // size)
        out.append((size, bucket if fits else bucket + 1, fits, each))
        rest = n - fits
        held += fits * size
        if rest:
            more = -(-rest // each)
            bucket += more
            held = (rest - (more - 1) * each) * size
    return out


def _bucket(nth: Column) -> Column:
    """The bucket of the nth cluster of a size under _next_fit."""
    after = F.floor((nth - F.col("takes")) / F.col("each"))
    return F.when(nth < F.col("takes"), F.col("bucket")).otherwise(F.col("bucket") + after + (F.col("takes") > 0).cast("int"))


def repacked(parted: DataFrame, limit: int) -> DataFrame:
    """parted (id, origin, part) with the parts of an oversized origin put together again into balanced ones of at most limit.

    Parts above limit are cut; the pieces of an origin, larger ones first, fill buckets of about its mean size one after the other.
    Of an origin only the numbers of pieces of each size come into one task.
    """
    fragments = parted.where("part IS NOT NULL OR big")
    place = ranked(fragments.select("id", "origin", "part"), ["origin", "part", "id"])
    begin = place.groupBy("origin", "part").agg(F.min("rank").alias("begin"))
    place = place.join(begin, [place["origin"] == begin["origin"], place["part"].eqNullSafe(begin["part"])]).select(place["*"], F.floor((F.col("rank") - F.col("begin")) / limit).alias("piece"))
    pieces = place.groupBy("origin", "part", "piece").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    order = ranked(pieces, ["origin", F.desc("size"), "first"], "nth_all")
    per = order.groupBy("origin", "size").agg(F.count("*").alias("n"), F.min("nth_all").alias("from"))
    kind = dict(parted.dtypes)["origin"]

    def fill(pdf):
        import math

        import pandas as pd

        rows = pdf.sort_values("size", ascending=False)
        total = int((rows["size"] * rows["n"]).sum())
        target = math.ceil(total / max(1, math.ceil(total / limit)))
        made = _next_fit(list(zip(rows["size"].tolist(), rows["n"].tolist())), max(target, int(rows["size"].max())))
        return pd.DataFrame({"origin": rows["origin"].to_numpy(), "size": rows["size"].to_numpy(), "from": rows["from"].to_numpy(), "bucket": [m[1] for m in made], "takes": [m[2] for m in made], "each": [m[3] for m in made]})

    how = per.groupBy("origin").applyInPandas(fill, f"origin {kind}, size long, `from` long, bucket long, takes long, each long")
    into = order.join(how, ["origin", "size"]).select("origin", "part", "piece", _bucket(F.col("nth_all") - F.col("from")).alias("bucket"))
    same = [place["origin"] == into["origin"], place["part"].eqNullSafe(into["part"]), place["piece"] == into["piece"]]
    return place.join(into, same).select(place["id"], place["origin"], F.col("bucket").cast("string").alias("part"))


def capped_topics(clusters: DataFrame, most: int, limit: int | None = None) -> DataFrame:
    """(id, topic) from clusters (id, origin, part): the most - 1 largest stay as they are, the others fill buckets of at most
    limit nodes one after the other, so that there may be more than most. Topics are numbered by size, then by first id.

    Clusters are ranked by ranges; what reaches the driver is how many clusters of each size there are.
    """
    sizes = clusters.groupBy("origin", "part").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    order = ranked(sizes, [F.desc("size"), "first"])
    n = order.count()
    head = n if n <= most else most - 1
    tail = order.where(F.col("rank") >= head)
    runs = tail.groupBy("size").agg(F.count("*").alias("n"), F.min("rank").alias("from")).orderBy(F.desc("size")).collect()
    room = limit if limit is not None else sum(r["size"] * r["n"] for r in runs)
    rows = [(r["size"], r["from"], *m[1:]) for r, m in zip(runs, _next_fit([(r["size"], r["n"]) for r in runs], max(1, room)))]
    how = clusters.sparkSession.createDataFrame(rows, "size long, `from` long, bucket long, takes long, each long")
    placed = order.join(F.broadcast(how), "size", "left").withColumn("topic", F.when(F.col("rank") < head, F.col("rank")).otherwise(head + _bucket(F.col("rank") - F.col("from"))))  # one row for each size
    same = [clusters["origin"] == placed["origin"], clusters["part"].eqNullSafe(placed["part"])]
    return clusters.join(placed.select("origin", "part", "topic"), same).select(clusters["id"], (F.col("topic") + 1).cast("bigint").alias("topic"))


def entity_clusters(nodes: DataFrame, edges: DataFrame, most: int = 12, limit: int | None = None, least: float = 2.0) -> DataFrame:
    """(id, topic): components under strong edges, the oversized ones parted by weight, then capped; nodes is (id)."""
    strong = staged(clustering_edges(edges, least), "strong-edges")  # read in every step
    clusters = components(nodes, strong).select("id", F.col("component").cast("string").alias("origin"))
    parted = split_oversized(clusters, strong, limit) if limit is not None else clusters.withColumn("part", F.lit(None).cast("string"))
    return capped_topics(parted, most, limit)


#: Fixed value: the theme of nodes that have no other.
OTHER_THEME = "אחר"


def theme_clusters(nodes: DataFrame, edges: DataFrame, most: int = 40, limit: int | None = None, least: float = 2.0) -> DataFrame:
    """(id, topic): nodes of one theme together, those without one by their strong edges; oversized clusters are parted by weight
    and put together again within their theme, then all are capped. nodes is (id, theme)."""
    strong = staged(clustering_edges(edges, least), "strong-edges")  # read in every step
    name = F.trim(F.regexp_replace(F.lower(F.coalesce("theme", F.lit(""))), r"\s+", " "))
    named = nodes.groupBy("id").agg(F.min(F.when((name != "") & (name != OTHER_THEME), name)).alias("theme"))
    loose = named.where("theme IS NULL").select("id")
    apart = strong.join(loose.select(F.col("id").alias("src")), "src", "left_semi").join(loose.select(F.col("id").alias("dst")), "dst", "left_semi")
    own = components(loose, apart).select("id", F.concat(F.lit("="), F.col("component").cast("string")).alias("origin"))
    clusters = staged(named.where("theme IS NOT NULL").select("id", F.concat(F.lit("#"), "theme").alias("origin")).unionByName(own), "theme-clusters")
    if limit is None:
        return capped_topics(clusters.withColumn("part", F.lit(None).cast("string")), most, None)
    big = clusters.groupBy("origin").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("origin")
    whole = clusters.join(big, "origin", "left_anti").select("id", "origin", F.lit(None).cast("string").alias("part"))
    parted = split_oversized(clusters.join(big, "origin", "left_semi"), strong, limit).withColumn("big", F.lit(True))
    return capped_topics(whole.unionByName(repacked(parted, limit)), most, limit)


def dominant_theme(members: DataFrame) -> DataFrame:
    """(topic, theme): the most frequent theme of each topic, the one that came first on a tie; members is (topic, pos, theme)."""
    n = members.where(F.trim(F.coalesce("theme", F.lit(""))) != "").groupBy("topic", "theme").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return n.groupBy("topic").agg(F.max_by("theme", F.struct("n", -F.col("pos"))).alias("theme"))


def topic_names(signatures: DataFrame) -> DataFrame:
    """(topic, name): a topic's first two names of its signature (topic, place, display), or its number; a name that an earlier
    topic has gets the topic's next name that isn't in it, and a number where that is taken too."""
    g = signatures.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "display"))), lambda x: x["display"]).alias("d"))
    base = F.when(F.size("d") > 0, F.array_join(F.slice("d", 1, 2), " / ")).otherwise(F.concat(F.lit("Topic "), F.col("topic").cast("string")))
    rows = g.select("topic", "d", base.alias("name"))
    again = F.row_number().over(Window.partitionBy("name").orderBy("topic"))
    more = F.get(F.filter("d", lambda x: ~F.contains(F.col("name"), x)), F.lit(0))
    rows = rows.withColumn("name", F.when(again > 1, F.concat_ws(" – ", "name", more)).otherwise(F.col("name")))
    twice = F.row_number().over(Window.partitionBy("name").orderBy("topic"))
    return rows.select("topic", F.when(twice > 1, F.concat(F.col("name"), F.lit(" ("), twice.cast("string"), F.lit(")"))).otherwise(F.col("name")).alias("name"))


def topic_matches(nodes: DataFrame, term: str, most: int = 12) -> DataFrame:
    """(chunk_id, score): the nodes that have most of a term's words and forms in their names, summary and text, one more where
    the whole term stands there; nodes is (chunk_id, entities, keyphrases, summary, text)."""
    keys = F.array_union(name_keys(F.lit(term)), plain_words(F.lit(term)))
    everything = F.concat_ws(" ", F.concat_ws(" ", "entities"), F.concat_ws(" ", "keyphrases"), "summary", "text")
    rows = nodes.select("chunk_id", plain_name(everything).alias("hay"), F.flatten(F.transform(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.array(F.lower(e)))).alias("names"))
    own = F.array_union(F.split("hay", " "), "names")
    score = F.size(F.array_intersect(own, keys)) + F.contains("hay", plain_name(F.lit(term))).cast("int")
    return rows.withColumn("score", score).where("score > 0").groupBy("chunk_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(most)


def walk(seeds: list, neighbours: dict[object, list[tuple[object, float]]], most: int) -> list:
    """Best-first from the seeds along the heaviest edges; equal weights in the order they were met."""
    heap, out, met, n = [], [], set(), 0
    for s in seeds:
        heapq.heappush(heap, (-math.inf, n, s))
        n += 1
    while heap and len(out) < most:
        _, _, x = heapq.heappop(heap)
        if x in met:
            continue
        met.add(x)
        out.append(x)
        for y, w in neighbours.get(x, ()):
            if y not in met:
                heapq.heappush(heap, (-w, n, y))
                n += 1
    return out


def evidence_walk(seeds: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(topic, place, id): at most `most` nodes of each topic: its seeds in their order, then best-first along the heaviest edges
    of the nodes taken, of equal ones that of the earlier node and then of the lower id; seeds is (topic, pos, id).

    One join per place. A node's `most` heaviest edges are enough: of more, some are never reached before the walk is full. No
    neighbourhood is gathered whole.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("to"), "weight").union(edges.select("dst", "src", "weight"))
    w = Window.partitionBy("id").orderBy(F.desc("weight"), "to")
    near = cut(both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n"))
    one = seeds.groupBy("topic", "id").agg(F.min("pos").alias("pos")).withColumn("place", F.row_number().over(Window.partitionBy("topic").orderBy("pos", "id")))
    taken = cut(one.where(F.col("place") <= most).select("topic", "id", "place"))
    count = taken.groupBy("topic").agg(F.max("place").alias("held"))
    for _ in range(1, most):
        count = taken.groupBy("topic").agg(F.max("place").alias("held")).where(F.col("held") < most)
        options = taken.join(count, "topic").join(near, "id").select("topic", F.col("to").alias("id"), "weight", "place", "held").join(taken.select("topic", "id"), ["topic", "id"], "left_anti")
        best = options.withColumn("n", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "place", "id"))).where("n = 1")
        best = cut(best.select("topic", "id", (F.col("held") + 1).alias("place")))
        if not best.limit(1).count():
            break
        taken = cut(taken.unionByName(best))
    return taken


def snap_theme(theme: Column, vocabulary: dict[str, str]) -> Column:
    """The vocabulary's spelling of a theme, else the theme as it is."""
    key = F.trim(F.regexp_replace(F.lower(theme), r"\s+", " "))
    if not vocabulary:
        return theme
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv]), key), theme)
