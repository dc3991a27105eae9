"""Numeric linking: priors, context vectors, posteriors, fusion and selection, as joins and array arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.operators.cascade import JOIN
from linkloom.session import lookup_join

MAX_CANDIDATES = 30
MAX_LINES = 3_001


# Array arithmetic


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def relu(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def matvec(rows: Column, v: Column) -> Column:
    """Product of a matrix, an array of rows, and a vector."""
    return F.transform(rows, lambda r: dot(r, v))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x.cast("double") - F.array_max(a).cast("double")))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def pad(a: Column, size: int, with_: Column) -> Column:
    """Array cut or filled up to size."""
    return F.slice(F.concat(a, F.array_repeat(with_, size)), 1, size)


def joint(parts: list[Column], rows: Column) -> Column:
    """Joint encoder: relu of the matrix product with the vectors joined end to end."""
    return relu(matvec(rows, F.concat(*parts)))


# Contexts


def contexts(tokens: Column, start: Column, end: Column, strict: bool = False) -> Column:
    """(left, right) of a mention at token positions start..end, counted from 0: the left up to and with the mention,
    the right from the mention on and reversed; strict leaves the mention out."""
    n = F.size(tokens)
    left_end, right_start = (start, end + 1) if strict else (end + 1, start)
    return F.struct(F.slice(tokens, 1, left_end).alias("left"), F.reverse(F.slice(tokens, right_start + 1, F.greatest(n - right_start, F.lit(0)))).alias("right"))


def token_mentions(line: Column) -> Column:
    """Array of (token_start, token_len, char_start, entity, alias, tag): the annotations of a line, counted in the word
    tokens of its bare text."""
    from linkloom.functions.markup import word_tokens
    from linkloom.operators.mentions import annotation_spans, bare_text

    pairs = F.transform(annotation_spans(line), lambda x: F.struct(F.substring(bare_text(line), 1, x["start"]).alias("before"), x.alias("x")))
    return F.transform(
        pairs,
        lambda p: F.struct(
            F.size(word_tokens(p["before"])).alias("token_start"), F.size(word_tokens(p["x"]["alias"])).alias("token_len"), p["x"]["start"].alias("char_start"),
            p["x"]["entity"].alias("entity"), p["x"]["alias"].alias("alias"), p["x"]["tag"].alias("tag"),
        ),
    )


def bracket_mention(tokens: Column, start: int, end: int) -> Column:
    """Tokens with link signs around those from start to end."""
    return F.array_insert(F.array_insert(tokens, end + 2, F.lit("]]")), start + 1, F.lit("[["))


def first_lines(lines: DataFrame, line_no: str = "line_no", most: int = MAX_LINES) -> DataFrame:
    """The lines of each page that the numeric linker reads; an option of that linker, used nowhere else."""
    return lines.where(F.col(line_no) < most)


def embed(df: DataFrame, key: str, tokens: str, vectors: DataFrame, unknown: str = "unk") -> DataFrame:
    """(key, pos, vector): the vector (word, vector) of each token, that of `unknown` where it has none."""
    words = df.select(key, F.posexplode(tokens).alias("pos", "word"))
    default = vectors.where(F.col("word") == unknown).agg(F.first("vector").alias("__unk"))
    found = lookup_join(words, vectors.select("word", "vector"), ["word"])
    return found.withColumn("vector", F.coalesce(F.col("vector"), default.scalar())).select(key, "pos", "vector")


def mean_vector(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """(keys, vector): mean over the rows of each key, dimension by dimension."""
    dims = rows.select(*keys, F.posexplode(vector).alias("d", "x")).groupBy(*keys, "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias(vector))


def coherence(bags: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """(key, d, value): relu of the sum of the weight rows (item, vector) of each bag's distinct items (key, item)."""
    hits = lookup_join(bags.select(key, "item").distinct(), weights, ["item"], "inner")
    return hits.select(key, F.posexplode("vector").alias("d", "w")).groupBy(key, "d").agg(F.greatest(F.sum(F.col("w").cast("double")), F.lit(0.0)).alias("value"))


def coherence_bag(mentions: DataFrame, page: str, surface: str) -> DataFrame:
    """(page, item): the surfaces of a page, spaces as underscores."""
    return mentions.select(page, F.translate(surface, " ", "_").alias("item")).distinct()


# Candidates


def prior_candidates(mentions: DataFrame, candidates: DataFrame, priors: DataFrame, key: str, surface: str) -> DataFrame:
    """(key, wid, prior): prior (surface, wid, p) of each mention's candidates (key, wid); uniform if it knows none."""
    given = lookup_join(candidates, mentions.select(key, surface).distinct(), [key], "inner")
    known = lookup_join(given, priors.select(F.col("surface").alias(surface), "wid", "p"), [surface, "wid"])
    w = Window.partitionBy(key)
    any_known = F.max(F.col("p").isNotNull()).over(w)
    uniform = 1 / F.count(F.lit(1)).over(w)
    return known.withColumns({"__any": any_known, "__u": uniform}).where("not __any or p is not null").select(key, "wid", F.when(F.col("__any"), F.col("p")).otherwise(F.col("__u")).alias("prior"))


def top_candidates(scored: DataFrame, key: str, score: str, tie: str, top: int = MAX_CANDIDATES) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def posterior(scored: DataFrame, key: str, score: Column) -> DataFrame:
    """scored with `posterior`: softmax of score over the candidates of a key."""
    w = Window.partitionBy(key)
    rows = scored.withColumn("__s", score.cast("double"))
    rows = rows.withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(w)))
    return rows.withColumn("posterior", F.col("__e") / F.sum("__e").over(w)).drop("__s", "__e")


def _share(column: str, w: Window) -> Column:
    total = F.sum(column).over(w)
    return F.when(total != 0, F.col(column) / total).otherwise(F.col(column))


def fuse(scored: DataFrame, key: str, prior: str = "prior", context: str = "context") -> DataFrame:
    """scored with `joint`: both made to sum to 1 per key, then x + y - xy, made to sum to 1 again."""
    w = Window.partitionBy(key)
    rows = scored.withColumns({"__x": _share(prior, w), "__y": _share(context, w)})
    rows = rows.withColumn("__j", F.col("__x") + F.col("__y") - F.col("__x") * F.col("__y"))
    return rows.withColumn("joint", _share("__j", w)).drop("__x", "__y", "__j")


def fuse_linear(scored: DataFrame, prior: str = "prior", context: str = "context", alpha: float = 0.5) -> DataFrame:
    return scored.withColumn("joint", (1 - alpha) * F.col(prior) + alpha * F.col(context))


def select_best(scored: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """(key, name): per key the candidate with the highest score, the first name between equals."""
    best = F.min(F.struct((-F.col(score)).alias("neg"), F.col(name).alias("name")))
    return scored.groupBy(key).agg(best.alias("b")).select(key, F.col("b.name").alias(name))


def greedy_choice(mentions: DataFrame, counts: DataFrame, key: str, alias: str = "alias", candidates: str = "candidates") -> DataFrame:
    """(key, entity): of the candidates, joined by ###, the one its alias names most often; the first listed one between
    equals and where no count is known."""
    each = mentions.select(key, alias, F.posexplode(F.split(candidates, JOIN)).alias("pos", "entity"))
    known = lookup_join(each, counts.select(F.col("alias").alias(alias), "entity", "n"), [alias, "entity"])
    best = F.min(F.struct((-F.coalesce("n", F.lit(0))).alias("neg"), "pos", "entity"))
    return known.groupBy(key).agg(best.alias("b")).select(key, F.col("b.entity").alias("entity"))


def context_choice(mentions: DataFrame, counts: DataFrame, words: DataFrame, entities: DataFrame, key: str, unknown: str = "unk") -> DataFrame:
    """(key, entity): the numeric linker's choice for mentions (key, alias, candidates, context: array of tokens).

    The context's vector is the mean of its tokens' vectors (words: word, vector; that of `unknown` for others). Candidates,
    joined by ###, with a vector (entities: entity, vector) are scored by its product with the context, made posterior by
    softmax, and fused with the prior, the alias's counts (alias, entity, n) of each. Mentions none of whose candidates
    has a vector have no row.
    """
    context = mean_vector(embed(mentions, key, "context", words, unknown).where("vector is not null"), [key]).withColumnRenamed("vector", "__context")
    each = mentions.select(key, "alias", F.explode(F.array_distinct(F.split("candidates", JOIN))).alias("entity"))
    scored = lookup_join(each, entities.select("entity", "vector"), ["entity"], "inner").join(context, key)
    known = lookup_join(scored, counts.select("alias", "entity", F.col("n").alias("prior")), ["alias", "entity"]).fillna(0, ["prior"])
    ranked = posterior(known.withColumn("prior", F.col("prior").cast("double")), key, dot(F.col("__context"), F.col("vector")))
    return select_best(fuse(ranked, key, "prior", "posterior"), key, "joint", "entity")


def resolve_ids(entities: DataFrame, title_wid: DataFrame, known: DataFrame, title: str = "entity") -> DataFrame:
    """entities with wid (of the title with underscores) and idx, only those that are known (wid, idx)."""
    rows = entities.withColumn("__t", F.translate(title, " ", "_"))
    return rows.join(title_wid.select(F.col("title").alias("__t"), "wid"), "__t").join(known, "wid").drop("__t")


def titles_of(places: DataFrame, known: DataFrame, title_wid: DataFrame) -> DataFrame:
    """(idx, wid, title): places in the vocabulary (idx) with their ids (known: wid, idx) and titles (title_wid: title, wid)."""
    return lookup_join(lookup_join(places, known.select("idx", "wid"), ["idx"], "inner"), title_wid.select("wid", "title"), ["wid"], "inner").select("idx", "wid", "title")


def with_fallback(mentions: DataFrame, neural: DataFrame, greedy: DataFrame, key: str) -> DataFrame:
    """(key, entity) of mentions (key): the numeric linker's choice (key, entity), else the greedy one."""
    first = lookup_join(mentions.select(key), neural.select(key, F.col("entity").alias("__neural")), [key])
    both = lookup_join(first, greedy.select(key, F.col("entity").alias("__greedy")), [key])
    return both.select(key, F.coalesce("__neural", "__greedy").alias("entity"))


# Types


def type_labels(scores: Column, threshold: float = 0.75) -> Column:
    """Positions, from 0, of the scores from threshold on; else that of the highest."""
    above = F.filter(F.transform(scores, lambda x, i: F.when(x >= threshold, i)), lambda i: i.isNotNull())
    return F.when(F.size(above) > 0, above).otherwise(F.array((F.array_position(scores, F.array_max(scores)) - 1).cast("int")))


def cross_entropy(p: Column) -> Column:
    return -F.log(F.greatest(p, F.lit(1e-12)))
