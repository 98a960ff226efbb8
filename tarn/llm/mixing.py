"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

The documents' values of some columns, from the coarsest to the finest, make a tree. A token budget flows from the root:
each node shares its tokens among its children by weight, and no child gets more than its leaves can give in the epochs
allowed. What a child cannot take goes to its siblings by their weights (a waterline: children are filled in the order
of capacity over weight); as a node's capacity is what its leaves can give, only what a whole subtree cannot take moves
on to the siblings of its ancestors. Tokens that do not divide go one each to the first open siblings by name.

A leaf with budget b and t tokens takes b div t whole epochs, and of the next epoch the longest prefix of documents
whose tokens fit in b mod t. The order of epoch e is that of md5(seed:e:doc_id:n_tokens). A prefix is the documents up to
some hash, so it is found from sums over hash ranges and then within the one range where it ends; no leaf is ever sorted
or gathered, whatever its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.sources import scratch

WORD, BLANK, BLANKS = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]*", " \t\n\x0b\x0c\r"
NONE = "(none)"
DIGITS = 3
FEW = 10_000
#: Sums of tokens times weights stay exact.
EXACT = "decimal(38,0)"


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """alloc for every node: nodes has parent columns, name, weight, cap and budget (the parent's tokens)."""
    siblings = Window.partitionBy(*parent)
    # by cap / weight; nodes of no weight have no capacity
    filled = siblings.orderBy(F.try_divide(F.col("cap").cast("double"), F.col("weight")).asc_nulls_last(), name)
    before, up_to = filled.rowsBetween(Window.unboundedPreceding, -1), siblings.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    n = nodes.withColumn("cap", F.col("cap").cast(EXACT)).withColumn("weight", F.col("weight").cast(EXACT))
    n = n.withColumn("left", F.col("budget").cast(EXACT) - F.coalesce(F.sum("cap").over(before), F.lit(0)).cast(EXACT))
    n = n.withColumn("open_weight", (F.sum("weight").over(siblings) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast(EXACT))
    n = n.withColumn("full", (F.col("weight") == 0) | (F.col("cap") * F.col("open_weight") <= F.col("weight") * F.col("left")))
    # the first sibling that is not full sets the waterline for all that follow
    n = n.withColumn("full", (F.col("weight") == 0) | (F.min(F.col("full").cast("int")).over(filled.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    n = n.withColumn("rest", (F.col("budget").cast(EXACT) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0).cast(EXACT)).over(siblings)).cast(EXACT))
    n = n.withColumn("over", F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0).cast(EXACT)).over(siblings).cast(EXACT))
    part = F.expr("CAST(weight * rest AS decimal(38,0)) div over")
    n = n.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(part).cast("long"))
    spare = F.col("rest").cast("long") - F.sum(F.when(~F.col("full"), F.col("alloc")).otherwise(0)).over(siblings)
    place = F.sum((~F.col("full")).cast("int")).over(up_to)
    n = n.withColumn("alloc", F.col("alloc") + F.when(~F.col("full") & (place <= spare), 1).otherwise(0))
    return n.drop("left", "open_weight", "full", "rest", "over")


def budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: Column | int, epochs: int) -> DataFrame:
    """leaves: the levels and tokens. Returns the levels, tokens, alloc and live (no weight is 0) of each leaf.

    weights: for each level the whole-numbered weight of each value; those not named have 1.
    """
    tree = leaves
    for level in levels:
        named = F.create_map(*[F.lit(x) for kv in weights.get(level, {}).items() for x in kv]) if weights.get(level) else None
        weight = F.coalesce(named[F.col(level)], F.lit(1)) if named is not None else F.lit(1)
        tree = tree.withColumn(f"w_{level}", weight.cast("long"))
    live = F.lit(True)
    for level in levels:
        live = live & (F.col(f"w_{level}") > 0)
    tree = tree.withColumn("live", live).withColumn("cap", F.when(live, F.col("tokens") * epochs).otherwise(0))
    total = F.lit(budget) if isinstance(budget, int) else budget
    tree = tree.withColumn("alloc", total.cast("long"))
    for depth, level in enumerate(levels):
        keys = levels[: depth + 1]
        nodes = tree.groupBy(*keys).agg(F.first(f"w_{level}").alias("weight"), F.sum("cap").alias("cap"), F.first("alloc").alias("budget"))
        shared = _share(nodes, levels[:depth], level).select(*keys, F.col("alloc"))
        tree = tree.drop("alloc").join(shared, keys)
    return tree.select(*levels, "tokens", "alloc", "live")


def count_words(text: Column) -> Column:
    """Each word with the blanks after it becomes one letter. regexp_count would hold all of a text's words at once, which is
    many times the text."""
    return F.coalesce(F.length(F.regexp_replace(F.ltrim(text, F.lit(BLANKS)), WORD + BLANK, "x")), F.lit(0)).cast("long")


def order(seed: int, epoch: Column, doc_id: Column, tokens: Column) -> Column:
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")), tokens.cast("string"))
    return F.md5(key.cast("binary"))


class Mix:
    """The plan for one table: leaves with their epochs, and the hash up to which the last epoch goes."""

    def __init__(self, docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], share: float, epochs: int, seed: int, doc_id: str = "doc_id", text: str = "text"):
        self.levels, self.seed, self.doc_id = levels, seed, doc_id
        self.names = list(levels)
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in levels.items()], count_words(F.col(text)).alias("n_tokens"))
        self.rows = scratch(rows, "mix-rows")
        leaves = scratch(self.rows.groupBy(*self.names).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
        total, n = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
        # few leaves are shared out in one task, without a shuffle for each of the tree's windows
        self.few = n <= FEW
        leaves = leaves.coalesce(1) if self.few else leaves
        shared = budgets(leaves, self.names, weights, int(total * share), epochs)
        shared = shared.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(F.col("live").cast("long")))
        shared = shared.withColumn("part", F.when(F.col("tokens") > 0, F.col("alloc") % F.col("tokens")).otherwise(0))
        self.leaves = scratch(shared, "mix-budgets")
        ordered = self._join(self.rows, self.leaves).where("part > 0 and n_tokens > 0").withColumn("hash", self._hash(F.col("doc_id"), F.col("n_tokens")))
        ordered = ordered.withColumn("range", F.substring("hash", 1, DIGITS))
        ranges = ordered.groupBy(*self.names, "range").agg(F.sum("n_tokens").alias("sum"), F.first("part").alias("part"))
        before = Window.partitionBy(*self.names).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0)))
        ending = ranges.where("before <= part and before + sum > part").select(*self.names, "range", "before")
        ending = scratch(ending, "mix-ranges")
        inner = self._join(ordered, ending, ["range"]).groupBy(*self.names, "hash").agg(F.sum("n_tokens").alias("n"), F.first("before").alias("before"), F.first("part").alias("part"))
        run = Window.partitionBy(*self.names).orderBy("hash").rowsBetween(Window.unboundedPreceding, 0)
        last = inner.withColumn("end", F.col("before") + F.sum("n").over(run)).where("end <= part").groupBy(*self.names).agg(F.max("hash").alias("last"))
        # where no document of the ending range fits, the prefix ends with the range before it
        cuts = ending.join(last, self.names, "left").select(*self.names, F.coalesce("last", "range").alias("cut"))
        self.cuts = scratch(self.leaves.join(cuts, self.names, "left").select(*self.names, "tokens", "alloc", "whole", "part", "cut"), "mix-cuts")

    def _hash(self, doc_id: Column, tokens: Column) -> Column:
        return order(self.seed, F.col("whole") + 1, doc_id, tokens)

    def _join(self, rows: DataFrame, small: DataFrame, more: list[str] = ()) -> DataFrame:
        """small has a row for each leaf: broadcast where these are few, else left to the planner."""
        return rows.join(F.broadcast(small) if self.few else small, [*self.names, *more])

    def _copies(self) -> Column:
        # documents without tokens cost nothing: they come with each whole epoch, and with a prefix if there is none
        free = (F.col("n_tokens") == 0) & (F.col("part") > 0)
        partly = free | ((F.col("part") > 0) & (F.col("hash") <= F.col("cut")))
        return (F.col("whole") + F.coalesce(partly.cast("int"), F.lit(0))).cast("long")

    def chosen(self) -> DataFrame:
        """Every document: doc_id, the levels, n_tokens, leaf_tokens, leaf_budget and copies."""
        rows = self._join(self.rows, self.cuts).withColumn("hash", self._hash(F.col("doc_id"), F.col("n_tokens")))
        return rows.select("doc_id", *self.names, "n_tokens", F.col("tokens").alias("leaf_tokens"), F.col("alloc").alias("leaf_budget"), self._copies().alias("copies"))

    def apply(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The documents with all their columns, each as often as chosen."""
        held = docs.select(F.struct("*").alias("_row"), F.col(f"`{self.doc_id}`").cast("long").alias("_id"), count_words(F.col(f"`{text}`")).alias("n_tokens"), *[F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in self.levels.items()])
        rows = self._join(held, self.cuts).withColumn("hash", self._hash(F.col("_id"), F.col("n_tokens")))
        rows = rows.withColumn("_copies", self._copies()).where("_copies > 0")
        rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        return rows.select("_row.*")


#: The tree of the registered query: sources are dealt to four domains by their number.
DOMAINS = ("web", "reference", "forum", "books")
WEIGHTS = {"domain": {"web": 4, "reference": 3, "forum": 1, "books": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}}


def document_levels() -> dict[str, Column]:
    number = F.regexp_extract("source", r"([0-9]+)$", 1)
    names = F.array(*[F.lit(d) for d in DOMAINS])
    domain = F.when(F.length(number).between(1, 9), F.element_at(names, (F.pmod(number.cast("int"), F.lit(len(DOMAINS))) + 1).cast("int")))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mix_documents(docs: DataFrame, share: float = 0.6, epochs: int = 4, seed: int = 29, weights: dict = WEIGHTS) -> DataFrame:
    """Every document with how often the mixture takes it.

    Defined cases: null in a level is a node of its own, "(none)"; a null text has no tokens, and documents without
    tokens come along with every epoch of their leaf, also a partial one, and once where their leaf has no tokens at all; rows with equal doc_id and token count are
    chosen together; a null doc_id hashes as empty; a weight of 0 takes a subtree out; if all leaves together cannot
    give the budget, each gives all it has; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    return Mix(docs, document_levels(), weights, share, epochs, seed).chosen()


def mix_sql(share: float = 0.6, epochs: int = 4, seed: int = 29, weights: dict = WEIGHTS) -> str:
    """mix_documents() in DuckDB SQL."""
    levels = ["domain", "lang", "source"]
    names = ", ".join(f"'{d}'" for d in DOMAINS)
    number = "regexp_extract(source, '([0-9]+)$', 1)"
    pick = lambda level: "CASE " + level + "".join(f" WHEN '{k}' THEN {w}" for k, w in weights.get(level, {}).items()) + " ELSE 1 END" if weights.get(level) else "1"
    parts = [
        f"""docs AS (SELECT doc_id, coalesce(CASE WHEN length({number}) BETWEEN 1 AND 9 THEN list_extract([{names}], (CAST({number} AS INTEGER) % {len(DOMAINS)}) + 1) END, '{NONE}') AS domain,
            coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS n_tokens FROM documents)""",
        f"""leaf AS (SELECT {", ".join(levels)}, CAST(sum(n_tokens) AS HUGEINT) AS tokens, {", ".join(f"{pick(x)} AS w_{x}" for x in levels)} FROM docs GROUP BY ALL)""",
        f"""tree0 AS (SELECT *, CASE WHEN {" AND ".join(f"w_{x} > 0" for x in levels)} THEN tokens * {epochs} ELSE 0 END AS cap, CAST(floor((SELECT sum(tokens) FROM leaf) * {share!r}::DOUBLE) AS HUGEINT) AS alloc FROM leaf)""",
    ]
    for depth, level in enumerate(levels):
        keys, by = ", ".join(levels[: depth + 1]), f"PARTITION BY {', '.join(levels[:depth])}" if depth else ""
        fill = f"{by} ORDER BY CAST(cap AS DOUBLE) / nullif(weight, 0) ASC NULLS LAST, {level} ROWS BETWEEN UNBOUNDED PRECEDING"
        parts += [
            f"node{depth} AS (SELECT {keys}, first(w_{level}) AS weight, CAST(sum(cap) AS HUGEINT) AS cap, first(alloc) AS budget FROM tree{depth} GROUP BY {keys})",
            f"""fill{depth} AS (SELECT *, budget - coalesce(sum(cap) OVER ({fill} AND 1 PRECEDING), 0) AS left_over,
                sum(weight) OVER ({by}) - coalesce(sum(weight) OVER ({fill} AND 1 PRECEDING), 0) AS open_weight FROM node{depth})""",
            f"full{depth} AS (SELECT *, weight = 0 OR min(CASE WHEN weight = 0 OR cap * open_weight <= weight * left_over THEN 1 ELSE 0 END) OVER ({fill} AND CURRENT ROW) = 1 AS is_full FROM fill{depth})",
            f"""rest{depth} AS (SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({by}) AS rest, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({by}) AS over_weight FROM full{depth})""",
            f"part{depth} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (weight * rest) // over_weight END AS part FROM rest{depth})",
            f"""alloc{depth} AS (SELECT {keys}, part + CASE WHEN NOT is_full AND sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER ({by} ORDER BY {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                <= rest - sum(CASE WHEN is_full THEN 0 ELSE part END) OVER ({by}) THEN 1 ELSE 0 END AS alloc FROM part{depth})""",
            f"tree{depth + 1} AS (SELECT t.* EXCLUDE (alloc), a.alloc FROM tree{depth} t JOIN alloc{depth} a USING ({keys}))",
        ]
    parts += [
        f"""cut AS (SELECT domain, lang, source, tokens, alloc, CASE WHEN tokens > 0 THEN alloc // tokens WHEN {" AND ".join(f"w_{x} > 0" for x in levels)} THEN 1 ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN alloc % tokens ELSE 0 END AS part FROM tree3)""",
        f"hashed AS (SELECT d.*, c.tokens, c.alloc, c.whole, c.part, md5(concat_ws(':', '{seed}', CAST(whole + 1 AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''), CAST(n_tokens AS VARCHAR))) AS hash FROM docs d JOIN cut c USING (domain, lang, source))",
        "run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY hash RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM hashed)",
    ]
    return "WITH " + ",\n".join(parts) + """
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(tokens AS BIGINT) AS leaf_tokens, CAST(alloc AS BIGINT) AS leaf_budget,
  CAST(whole + CASE WHEN part > 0 AND (n_tokens = 0 OR upto <= part) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM run"""
