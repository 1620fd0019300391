"""Finding, masking and restoring personal data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import pii, text as tx
from tallymill.plans.ordered import global_number
from tallymill.plans.skew import is_small, lookup_join
from tallymill.session import checkpointed

Labels = Iterable[str] | None


def scan(df: DataFrame, key: str, text: str = "text", labels: Labels = None) -> DataFrame:
    """One row per value found: key, pos (0-based order in the text), label, value."""
    return (df.select(key, F.posexplode(pii.matches(F.col(text), labels)).alias("pos", "value"))
            .select(key, "pos", pii.label_of(F.col("value")).alias("label"), "value"))


def census(df: DataFrame, key: str, group: list[str], text: str = "text", labels: Labels = None) -> DataFrame:
    """Values, distinct values and affected rows per label and group."""
    found = (df.select(key, *group, F.explode(pii.matches(F.col(text), labels)).alias("value"))
             .withColumn("label", pii.label_of(F.col("value"))))
    return found.groupBy(*group, "label").agg(
        F.count("*").alias("n_values"),
        F.count_distinct("value").alias("n_distinct"),
        F.count_distinct(key).alias("n_rows"))


def mask(df: DataFrame, text: str = "text", labels: Labels = None, prefix: str = pii.DEFAULT_PREFIX,
         into: str = "masked") -> DataFrame:
    """Reversible mask with one vault per row: adds ``into`` and ``vault`` (placeholder -> value).

    Equal values share a placeholder. One counter serves all labels and starts at the last value of
    the text. Everything stays inside the row: no shuffle, no Python.
    """
    source = F.col(text)
    found = df.withColumn("_found", pii.matches(source, labels))

    def marker(value: Column, number: Column) -> Column:
        return pii.placeholder(pii.label_of(value), number, prefix)

    def hide(values: Column) -> Column:
        fillers = F.zip_with("_found", tx.numbers_from_last(F.col("_found")), marker)
        return F.struct(
            tx.interleave(pii.pieces(source, labels), fillers).alias("text"),
            F.map_from_arrays(F.transform(values, lambda v, i: marker(v, i + 1)), values).alias("vault"))

    hidden = F.when(F.size("_found") > 0, tx.let(F.array_distinct(F.reverse("_found")), hide))
    empty = F.create_map().cast("map<string,string>")
    return (found.withColumn("_hidden", hidden)
            .withColumns({into: F.coalesce(F.col("_hidden.text"), source),
                          "vault": F.coalesce(F.col("_hidden.vault"), empty)})
            .drop("_found", "_hidden"))


def vault_rows(masked: DataFrame, scope: str) -> DataFrame:
    """The vault table of row-masked data: scope_id, placeholder, label, original_value."""
    return (masked.select(F.col(scope).alias("scope_id"),
                          F.explode("vault").alias("placeholder", "original_value"))
            .select("scope_id", "placeholder", pii.label_of(F.col("original_value")).alias("label"),
                    "original_value"))


def _positions(df: DataFrame, columns: list[str], text: str, labels: Labels) -> DataFrame:
    return df.select(*columns, F.posexplode(pii.matches(F.col(text), labels)).alias("pos", "value"))


def _numbered_vault(found: DataFrame, order: str, prefix: str, start: int) -> DataFrame:
    first = (found.groupBy("value")
             .agg(F.min(F.struct(F.col(order).alias("at"), (-F.col("pos")).alias("back"))).alias("first"))
             .select("value", "first.at", "first.back"))
    numbered = global_number(first, ["at", "back"], "number")
    label = pii.label_of(F.col("value"))
    return numbered.select(
        pii.placeholder(label, F.col("number") + start, prefix).alias("placeholder"),
        label.alias("label"), F.col("value").alias("original_value"))


def corpus_vault(df: DataFrame, order: str, text: str = "text", labels: Labels = None,
                 prefix: str = pii.DEFAULT_PREFIX, start: int = 0) -> DataFrame:
    """One vault for all rows: distinct values numbered in the order a row-by-row run meets them
    (rows by ``order``, inside a row from the last value backwards), continuing after ``start``."""
    return _numbered_vault(_positions(df, [order], text, labels), order, prefix, start)


def _gather(df: DataFrame, replaced: DataFrame, key: str, value: str, text: str, between: Column, into: str,
            few: bool) -> DataFrame:
    """Texts with the values of ``replaced`` (key, pos, value) between their pieces. Where the values
    are few their rows are broadcast and the texts stay where they are."""
    fillers = replaced.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("_fillers"))
    whole = tx.interleave(between, F.col(f"_fillers.{value}"))
    return (df.join(F.broadcast(fillers) if few else fillers, key, "left")
            .withColumn(into, F.when(F.col("_fillers").isNull(), F.col(text)).otherwise(whole))
            .drop("_fillers"))


def _fill(df: DataFrame, found: DataFrame, vault: DataFrame, key: str, text: str, labels: Labels, into: str) -> DataFrame:
    names = vault.select(F.col("original_value").alias("value"), "placeholder")
    replaced = lookup_join(found, names, ["value"], "inner", stored=True)
    return _gather(df, replaced, key, "placeholder", text, pii.pieces(F.col(text), labels), into, is_small(found))


def mask_with_vault(df: DataFrame, vault: DataFrame, key: str, text: str = "text", labels: Labels = None,
                    into: str = "masked") -> DataFrame:
    """Mask with a given vault that knows all values. ``key`` must identify a row."""
    return _fill(df, checkpointed(_positions(df, [key], text, labels)), vault, key, text, labels, into)


def mask_corpus(df: DataFrame, key: str, order: str, text: str = "text", labels: Labels = None,
                prefix: str = pii.DEFAULT_PREFIX) -> tuple[DataFrame, DataFrame]:
    """Reversible mask with one vault for the whole corpus. Returns (masked rows, vault).

    The texts are searched once: the values found, a small table next to the texts, are stored and
    serve both the numbering and the replacement.
    """
    found = checkpointed(_positions(df, list(dict.fromkeys([key, order])), text, labels))
    vault = checkpointed(_numbered_vault(found, order, prefix, 0))
    return _fill(df, found.select(key, "pos", "value"), vault, key, text, labels, "masked"), vault


def unmask_row(df: DataFrame, text: str = "masked", vault: str = "vault", prefix: str = pii.DEFAULT_PREFIX,
               into: str = "restored") -> DataFrame:
    """Restore from the row's own vault map; unknown placeholders stay.

    ``mask`` lists a vault in the order of its numbers, so a placeholder's number says where to look;
    only a vault of another make is searched.
    """
    token = pii.placeholder_pattern(prefix)
    found = F.regexp_extract_all(F.col(text), F.lit(token), F.lit(0))

    def restore(v: Column) -> Column:
        def original(t: Column) -> Column:
            at = F.try_to_number(F.regexp_extract(t, r"_([0-9]{1,9})\]\]$", 1), F.lit("999999999")).cast("int") - 1
            return F.when(F.get(v["names"], at) == t, F.get(v["values"], at)).otherwise(
                F.coalesce(F.try_element_at(F.col(vault), t), t))

        return F.transform(found, original)

    entries = F.struct(F.map_keys(vault).alias("names"), F.map_values(vault).alias("values"))
    whole = tx.interleave(F.split(F.col(text), token, -1), tx.let(entries, restore))
    return df.withColumn(into, F.when(F.contains(F.col(text), F.lit(f"[[{prefix}_")), whole).otherwise(F.col(text)))


def unmask(df: DataFrame, vault: DataFrame, key: str, scope: list[str], text: str = "masked",
           prefix: str = pii.DEFAULT_PREFIX, into: str = "restored") -> DataFrame:
    """Restore from a vault table keyed by (scope..., placeholder). ``key`` must identify a row.

    ``scope`` names the columns of both tables that choose the vault; an empty list means one vault.
    """
    token = pii.placeholder_pattern(prefix)
    tokens = F.when(F.contains(F.col(text), F.lit(f"[[{prefix}_")), F.regexp_extract_all(F.col(text), F.lit(token), F.lit(0)))
    found = checkpointed(df.select(*dict.fromkeys([key, *scope]), F.posexplode(tokens).alias("pos", "placeholder")))
    originals = vault.select(*scope, "placeholder", "original_value")
    restored = (lookup_join(found, originals, [*scope, "placeholder"], "left", stored=True)
                .withColumn("value", F.coalesce("original_value", "placeholder")))
    return _gather(df, restored, key, "value", text, F.split(F.col(text), token, -1), into, is_small(found))


def write_vault(vault: DataFrame, path: str, mode: str = "append") -> None:
    """Store vault rows by scope, so that one scope is restored or replaced alone."""
    vault.write.mode(mode).partitionBy("scope_id").parquet(path)


def upsert_vault(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new rows; a (scope, placeholder) present in both keeps the new value."""
    both = (stored.select("scope_id", "placeholder", "label", "original_value").withColumn("_new", F.lit(0))
            .unionByName(new.select("scope_id", "placeholder", "label", "original_value")
                         .withColumn("_new", F.lit(1))))
    return (both.groupBy("scope_id", "placeholder")
            .agg(F.max(F.struct("_new", "label", "original_value")).alias("_last"))
            .select("scope_id", "placeholder", "_last.label", "_last.original_value"))


def restore_scope(vault: DataFrame, scope_id) -> DataFrame:
    return vault.filter(F.col("scope_id") == scope_id)


def drop_scope(vault: DataFrame, scope_id) -> DataFrame:
    return vault.filter(F.col("scope_id") != scope_id)


def vault_stats(vault: DataFrame) -> DataFrame:
    """Entries and highest number per scope; numbering of a restored scope goes on from there."""
    number = F.regexp_extract("placeholder", r"_([0-9]+)\]\]$", 1).cast("bigint")
    return vault.groupBy("scope_id").agg(
        F.count("*").alias("n_entries"), F.max(number).alias("last_number"))


def leaks(df: DataFrame, key: str, texts: list[str], labels: Labels = None) -> DataFrame:
    """Rows whose stored texts still hold personal data: key, field, label, value."""
    # Each text is searched where it stands; only the values found are taken apart.
    found = F.array(*[F.struct(F.lit(t).alias("field"), pii.matches(F.col(t), labels).alias("values")) for t in texts])
    return (df.select(key, F.explode(found).alias("f"))
            .select(key, "f.field", F.explode("f.values").alias("value"))
            .select(key, "field", pii.label_of(F.col("value")).alias("label"), "value"))


_SPAN = "struct<start:int,back:int,at:int,value:string>"


def _spans(text: Column, pattern: str, at: int) -> Column:
    """Non-empty matches of one pattern with their places: what stands between matches tells where they are."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def placed(both: Column) -> Column:
        # An empty match at the very start has no piece before it.
        pieces = F.when(F.size(both["between"]) == F.size(both["found"]), F.concat(F.array(F.lit("")), both["between"])).otherwise(both["between"])
        sizes = F.zip_with(F.slice(pieces, F.lit(1), F.size(both["found"])), both["found"], lambda p, f: F.struct(
            F.length(p).alias("gap"), F.length(f).alias("size"), f.alias("value")))
        # A running sum over chunks: the elements carry their own start.
        start = F.struct(F.lit(0).alias("reached"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))

        def chunk(acc: Column, number: Column) -> Column:
            def element(x: Column, item: Column) -> Column:
                begin = x["reached"] + item["gap"]
                span = F.struct(begin.alias("start"), (-begin - item["size"]).alias("back"), F.lit(at).alias("at"), item["value"].alias("value"))
                return F.struct((begin + item["size"]).alias("reached"), F.concat(x["out"], F.array(span)).alias("out"))

            inner = F.aggregate(F.slice(sizes, number * tx.CHUNK + 1, F.lit(tx.CHUNK)),
                                F.struct(acc["reached"].alias("reached"), F.array().cast(f"array<{_SPAN}>").alias("out")), element)
            return tx.let(inner, lambda x: F.struct(x["reached"].alias("reached"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

        numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.size(both["found"]) - 1) / tx.CHUNK).cast("int")))
        return F.filter(F.flatten(F.aggregate(numbers, start, chunk, lambda acc: acc["out"])), lambda x: x["value"] != "")

    return F.when(F.size(found) > 0, tx.let(F.struct(found.alias("found"), between.alias("between")), placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def mask_custom(df: DataFrame, patterns: Mapping[str, str], text: str = "text",
                prefix: str = pii.DEFAULT_PREFIX, into: str = "masked") -> DataFrame:
    """Mask with the user's own patterns (Java's syntax, classes such as ``\\w`` are Unicode) in place of the default ones.

    Every pattern finds its matches on its own; where they overlap, the earliest start wins, then the longest, then
    the pattern named first. Matches in that order are one fold: a match is taken if it begins where the one before has
    ended. A pattern that matches an empty text is refused. Numbers are given from the last new value to the first; a value has the label of
    its last place. Local to the row, no Python. A null text stays null.
    """
    labels = list(patterns)
    if not labels:
        return df.withColumn(into, F.col(text))
    for label, pattern in patterns.items():
        if df.sparkSession.sql("SELECT regexp_like('', :p)", args={"p": f"(?U){pattern}"}).first()[0]:
            raise ValueError(f"the pattern of {label!r} matches an empty text: {pattern!r}")
    spans, kept, values = (_free(df, name) for name in ("_spans", "_kept", "_values"))
    each = [_spans(F.col(text), f"(?U){pattern}", at) for at, pattern in enumerate(patterns.values())]
    found = df.withColumn(spans, F.sort_array(F.concat(*each)))
    chosen = found.withColumn(kept, F.when(F.size(spans) > 0, tx.chunked_fold(
        F.col(spans), F.lit(0), lambda _, x: -x["back"], lambda reached, x: x["start"] >= reached, _SPAN)))
    flat = chosen.withColumn(values, F.flatten(kept))

    def pieces(chunks: Column) -> Column:
        """The text before every match, cut out of the part of its chunk, and the text behind the last one."""
        def part(chunk: Column, number: Column) -> Column:
            begin = F.when(number > 0, -F.element_at(F.get(chunks, number - 1), -1)["back"]).otherwise(0)
            end = -F.element_at(chunk, -1)["back"]
            return tx.let(F.struct(F.substring(F.col(text), begin + 1, end - begin).alias("text"), begin.alias("begin")), lambda own: F.transform(
                chunk, lambda x, i: tx.let(F.when(i > 0, -F.get(chunk, i - 1)["back"]).otherwise(own["begin"]), lambda before: F.substring(
                    own["text"], before - own["begin"] + 1, x["start"] - before))))

        last = -F.element_at(F.element_at(chunks, -1), -1)["back"]
        return F.concat(F.flatten(F.transform(chunks, part)), F.array(F.substring(F.col(text), last + 1, F.length(text))))

    names = F.array(*[F.lit(label) for label in labels])
    numbers = tx.numbers_from_last(F.transform(values, lambda x: x["value"]))

    def tokens(both: Column) -> Column:
        # Of the places of a value the last one has its label.
        places = F.sort_array(F.zip_with(both["numbers"], F.transform(both["values"], lambda x, i: F.struct((-i).alias("place"), x["at"].alias("at"))),
                                         lambda n, x: F.struct(n.alias("n"), x["place"].alias("place"), x["at"].alias("at"))))
        return tx.let(places, lambda p: tx.let(
            F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1)["n"] != x["n"])),
            lambda heads: F.transform(both["numbers"], lambda n: pii.placeholder(F.get(names, F.get(heads, n - 1)["at"]), n, prefix))))

    fillers = tx.let(F.struct(numbers.alias("numbers"), F.col(values).alias("values")), tokens)
    masked = F.when(F.size(values) > 0, tx.interleave(pieces(F.col(kept)), fillers)).otherwise(F.col(text))
    return flat.withColumn(into, masked).drop(spans, kept, values)


def _free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
