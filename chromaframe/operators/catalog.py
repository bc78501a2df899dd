"""Catalogue operators: layers, channel groups, filters, list maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..storage import numbered

#: Channel tails that belong together, in order of preference. Fixed values.
GROUPS = (("R", "G", "B"), ("r", "g", "b"), ("C",), ("c",), ("M",), ("m",), ("X", "Y", "Z"), ("x", "y", "z"), ("K",), ("k",), ("U", "V"), ("u", "v"), ("Z",), ("z",))


def select_channels(channels: DataFrame, selector: str, by: list[str], name: str = "channel", ordinal: str = "ordinal") -> DataFrame:
    """Channels that match, with their new position: first by the word of the selector they match, then as they were."""
    found = channels.withColumn("_word", N.fuzzy_match_id(F.col(name), selector)).where("_word is not null")
    return found.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("_word", ordinal)) - 1).drop("_word")


def layers(channels: DataFrame, by: list[str], name: str = "channel") -> DataFrame:
    """Distinct layers with their rank in natural order."""
    found = channels.select(*by, N.layer_of(F.col(name)).alias("layer")).distinct()
    return found.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(N.natural_key(F.col("layer")), "layer")) - 1)


def channel_groups(channels: DataFrame, by: list[str], name: str = "channel", ordinal: str = "ordinal") -> DataFrame:
    """by, layer, position, group_name, channels: channels of a layer in their usual groups, leftovers alone, alpha in each.

    Rules are an expression over the tail, and each layer's few channels meet in one aggregation.
    """
    parts = channels.select(*by, F.col(name).alias("channel"), F.col(ordinal).alias("ordinal"), N.layer_of(F.col(name)).alias("layer"), N.tail_of(F.col(name)).alias("tail"))
    places: dict[str, int] = {}
    for g, group in enumerate(GROUPS):
        for i, t in enumerate(group):
            places.setdefault(t, g * 10 + i)  # Z goes with X and Y
    place = F.create_map(*[F.lit(x) for kv in places.items() for x in kv])
    rank = F.coalesce(F.try_element_at(place, F.col("tail")), F.lit(1000) + F.col("ordinal") * 10)
    alpha = F.max(F.when(F.col("tail") == "A", F.col("channel"))).over(Window.partitionBy(*by, "layer"))
    colours = F.count(F.when(F.col("tail") != "A", F.lit(1))).over(Window.partitionBy(*by, "layer"))
    ranked = parts.withColumn("_alpha", alpha).withColumn("_colours", colours).withColumn("_rank", rank).where((F.col("tail") != "A") | (F.col("_colours") == 0))
    grouped = ranked.groupBy(*by, "layer", F.floor(F.col("_rank") / 10).alias("_group")).agg(F.array_sort(F.collect_list(F.struct("_rank", "channel"))).alias("m"), F.max("_alpha").alias("_alpha"), F.max("_colours").alias("_colours"))
    own = F.transform("m", lambda s: s["channel"])
    with_alpha = F.when(F.col("_alpha").isNotNull() & (F.col("_colours") > 0), F.concat(own, F.array("_alpha"))).otherwise(own)
    out = grouped.withColumn("channels", with_alpha).withColumn("tails", F.array_join(F.transform(F.col("channels"), N.tail_of), ","))
    shown = F.when(F.col("layer") == "", F.col("tails")).when(F.size("channels") == 1, F.concat("layer", "tails")).otherwise(F.concat(F.col("layer"), F.lit("("), F.col("tails"), F.lit(")")))
    position = F.row_number().over(Window.partitionBy(*by, "layer").orderBy("_group")) - 1
    return out.select(*by, "layer", position.alias("position"), shown.alias("group_name"), "channels")


def ungroup(groups: DataFrame) -> DataFrame:
    """One row per channel of each group; a name that comes up again is left out."""
    return groups.select(*[c for c in groups.columns if c not in ("channels", "group_name")], F.explode("channels").alias("group_name")).dropDuplicates()


def filter_catalog(images: DataFrame, groups: DataFrame, pattern: str, key: str = "image_id", use_regex: bool = False) -> DataFrame:
    """Images whose name matches and that have a group that matches; pattern is image:group."""
    image_filter, group_filter = N.split_filter(pattern)
    found = groups.where(N.matches(F.col("group_name"), group_filter, use_regex)).select(key)
    return images.where(N.matches(F.col("name"), image_filter, use_regex)).join(found, key, "left_semi")


def suffix_duplicates(channels: DataFrame, by: list[str], name: str = "channel", ordinal: str = "ordinal") -> DataFrame:
    """Adds unique_name: the k-th repeat of a name is head + k + '.' + tail."""
    k = F.row_number().over(Window.partitionBy(*by, name).orderBy(ordinal)) - 1
    renamed = F.concat(N.layer_of(F.col(name)), k.cast("string"), F.lit("."), N.tail_of(F.col(name)))
    return channels.withColumn("unique_name", F.when(k == 0, F.col(name)).otherwise(renamed))


def first_of_each(rows: DataFrame, value: list[str], order: list[str]) -> DataFrame:
    """Distinct values, each with its first row: an aggregate, so that of a hot value each task passes on one row."""
    return rows.groupBy(*value).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first")).select("_first.*")


def drop_repeats_in_a_row(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_before", F.lag(value).over(w)).withColumn("_k", F.row_number().over(w)).where((F.col("_k") == 1) | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_k")


def nth_visible(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The n-th row from 0 of each group, or the last."""
    w = Window.partitionBy(*by)
    return rows.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_k") == F.least(F.lit(n + 1), F.col("_n"))).drop("_k", "_n")


def upsert(current: DataFrame, changes: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Changed rows take the place of those with their key, new ones follow at the end in the order of their key.

    Rows that are there keep their ordinal by a join; only the new ones are numbered, over many tasks.
    """
    others = [c for c in current.columns if c != ordinal]
    there = current.alias("o").join(changes.alias("n"), key, "left")
    kept = there.select(*[F.col(key) if c == key else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in others], F.col(f"o.{ordinal}").cast("long").alias(ordinal))
    fresh = numbered(changes.join(current.select(key), key, "left_anti").select(*others), [key], "_new")
    last = current.agg(F.coalesce(F.max(ordinal), F.lit(-1)).alias("_last"))  # one row
    return kept.unionByName(fresh.crossJoin(F.broadcast(last)).select(*others, (F.col("_last") + 1 + F.col("_new")).cast("long").alias(ordinal)))


def delete(current: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return current.join(gone.select(key), key, "left_anti")


def insert_at(current: DataFrame, new: DataFrame, index: int, ordinal: str = "ordinal") -> DataFrame:
    """New rows, in their own order, before the row at index; rows from there on move back."""
    count = new.agg(F.count(F.lit(1)).alias("_count"))  # one row
    moved_back = current.crossJoin(F.broadcast(count)).withColumn(ordinal, (F.col(ordinal) + F.when(F.col(ordinal) >= index, F.col("_count")).otherwise(0)).cast("long")).drop("_count")
    placed = numbered(new, [ordinal], "_new").withColumn(ordinal, (F.col("_new") + index).cast("long")).drop("_new")
    return moved_back.unionByName(placed.select(*current.columns))


def selected_after_delete(rows: DataFrame, by: list[str], gone: Column, visible: Column, ordinal: str = "ordinal") -> DataFrame:
    """by and selected: the visible row that follows the deleted one, else the one before it, else none."""
    at = rows.where(gone).select(*by, F.col(ordinal).alias("_gone"))
    met = rows.where(visible).join(at, by)
    follows, before = F.min(F.when(F.col(ordinal) > F.col("_gone"), F.col(ordinal))), F.max(F.when(F.col(ordinal) < F.col("_gone"), F.col(ordinal)))
    return at.join(met.groupBy(*by).agg(F.coalesce(follows, before).alias("selected")), by, "left").select(*by, "selected")


def reselected(rows: DataFrame, by: list[str], visible: Column, current: Column, reference: Column, ordinal: str = "ordinal") -> DataFrame:
    """by, current and reference after a filter has changed: the current row if it is visible, else the first visible one; the
    reference only if it is visible itself. current and reference mark at most one row each."""
    at = F.col(ordinal)
    mine, first = F.max(F.when(visible & current, at)), F.min(F.when(visible, at))
    return rows.groupBy(*by).agg(F.coalesce(mine, first).alias("current"), F.max(F.when(visible & reference, at)).alias("reference"))


def sorted_attributes(attributes: DataFrame, by: list[str], tab: str, name: str) -> DataFrame:
    """Adds tab_position by the bytes of the tab's name, and position inside the tab in the order of names."""
    tabs = Window.partitionBy(*by)
    return attributes.withColumn("tab_position", F.dense_rank().over(tabs.orderBy(tab)) - 1).withColumn("position", F.row_number().over(Window.partitionBy(*by, tab).orderBy(name)) - 1)


def delete_visible(current: DataFrame, visible: Column) -> DataFrame:
    """What a filter hides stays."""
    return current.where(~F.coalesce(visible, F.lit(False)))


def lookup_first(rows: DataFrame, by: list[str], match: Column, value: str, order: str = "ordinal", fallback: bool = False) -> DataFrame:
    """by and value of the first row that matches; with fallback, of the first row where none does."""
    found = F.min_by(value, F.when(match, F.col(order)))
    return rows.groupBy(*by).agg((F.coalesce(found, F.min_by(value, order)) if fallback else found).alias(value))


def single_groups(channels: DataFrame, by: list[str], name: str = "channel", ordinal: str = "ordinal") -> DataFrame:
    """Without grouping: each channel is a group that shows it in all three colours."""
    return channels.select(*by, F.col(ordinal).alias("position"), F.col(name).alias("group_name"), F.array_repeat(name, 3).alias("channels"))


def sorted_parts(parts: DataFrame, by: list[str], name: str, natural: bool) -> DataFrame:
    """Adds position by the bytes of the name or by natural order."""
    order = [N.natural_key(F.col(name)), F.col(name)] if natural else [F.col(name)]
    return parts.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def append_channels(pixels: DataFrame, others: DataFrame, layer: str) -> DataFrame:
    """The channels of both; the others' names get a layer in front."""
    named = others.withColumn("channel", N.join_if_not_empty(F.lit(layer), F.col("channel")))
    return pixels.unionByName(named.select(*pixels.columns))


def size_to_fit(sizes: DataFrame, by: list[str]) -> DataFrame:
    """The largest width and the largest height of a group's images."""
    return sizes.groupBy(*by).agg(F.max("width").alias("width"), F.max("height").alias("height"))


def _seconds(at: Column) -> Column:
    return at.cast("timestamp").cast("double")


def load_batches(loads: DataFrame, by: list[str], at: str = "ts") -> DataFrame:
    """How many images a batch has loaded, and the seconds from the first to the last."""
    return loads.groupBy(*by).agg(F.count(F.lit(1)).alias("images"), (_seconds(F.max(at)) - _seconds(F.min(at))).alias("seconds"))


def traffic(packets: DataFrame, by: list[str], payload: str, connection: str) -> DataFrame:
    """Bytes, packets and connections, exactly."""
    return packets.groupBy(*by).agg(F.sum(F.octet_length(payload)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("packets"), F.countDistinct(connection).alias("connections"))


def new_files(listing: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    return listing.join(seen.select(*key), key, "left_anti")


def moved(ordinal: Column, old: int, new: int) -> Column:
    """Ordinals after the row at old has been moved to new."""
    if old < new:
        return F.when(ordinal == old, F.lit(new)).when((ordinal > old) & (ordinal <= new), ordinal - 1).otherwise(ordinal)
    return F.when(ordinal == old, F.lit(new)).when((ordinal >= new) & (ordinal < old), ordinal + 1).otherwise(ordinal)


def contiguous_prefix(rows: DataFrame, by: list[str], ident: str) -> DataFrame:
    """Rows up to the first gap in the identifiers, counted from each group's least."""
    w = Window.partitionBy(*by).orderBy(ident)
    lowest = F.min(ident).over(Window.partitionBy(*by))
    return rows.withColumn("_run", F.col(ident) - F.row_number().over(w) + 1).withColumn("_low", lowest).where("_run = _low").drop("_run", "_low")


def common_affixes(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Code points that all names of a group begin and end with: those of the least and the greatest, forwards and reversed."""
    ends = rows.groupBy(*by).agg(F.min(name).alias("_a"), F.max(name).alias("_b"), F.min(F.reverse(name)).alias("_c"), F.max(F.reverse(name)).alias("_d"))
    return ends.select(*by, N.common_prefix_length(F.col("_a"), F.col("_b")).alias("prefix"), N.common_prefix_length(F.col("_c"), F.col("_d")).alias("suffix"))


def numbered_distinct(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, position of each distinct value in its group, and how many there are."""
    distinct = rows.select(*by, value).distinct()
    w = Window.partitionBy(*by)
    return distinct.withColumn("position", F.dense_rank().over(w.orderBy(value)) - 1).withColumn("distinct_values", F.count(F.lit(1)).over(w))


def summaries(channels: DataFrame, by: list[str], name: str = "channel") -> DataFrame:
    """One line per image: each layer with its channels in order."""
    layered = channels.groupBy(*by, N.layer_of(F.col(name)).alias("layer")).agg(F.array_join(F.array_sort(F.collect_set(N.tail_of(F.col(name)))), ",").alias("tails"))
    line = F.concat("layer", F.lit(": "), "tails")
    return layered.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(line)), "; ").alias("summary"), F.count(F.lit(1)).alias("layers"))
