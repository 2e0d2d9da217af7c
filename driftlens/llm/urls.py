"""URL filters: rules first, then a ratio of character language models.

A rule names a host and a path. It fits its host and all subdomains, if the
URL's path begins with the rule's; the longest rule that fits decides. URLs
without a rule are judged by two variable-order Markov models over the
characters of host and path, one of the URLs that rules allow and one of those
they block. Each model blends the orders 0 to ``ORDER`` by Witten-Bell
smoothing: a context that was followed by many different characters trusts the
shorter context more. The score is the log-likelihood ratio per character, and
the threshold is where it best separates ruled URLs that the models did not see.

Counts cover all URLs with a rule, and the ratio of a character in its context is
computed once per distinct gram of the URLs to judge; both are tables that Spark
aggregates and joins, so nothing that follows the data is gathered or shared.

Defined results: a null URL, or one without ``://``, has an empty host and path
and is judged as such. With no allowed or no blocked URL to learn from, every
score is 0 and URLs without a rule are allowed. Repeated rows are each returned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.session import cut_lineage

ORDER = 4
FOLDS = 5
MAX_RULES = 1000
_START, _STOP = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLASSES = ("allow", "block")


@dataclass(frozen=True)
class Rule:
    """``text`` is host and path, like ``example.net/en/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: list[Rule], host: str = "host", path: str = "path") -> Column:
    """Struct (text, verdict) of the rule that decides, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col(host) == r.host) | F.endswith(F.col(host), F.lit(f".{r.host}"))) & F.startswith(F.col(path), F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _grams(text: str, order: int) -> Column:
    """Each character of a text, and its end, after its ``order`` predecessors."""
    chars = F.split(F.concat(F.lit(_START * order), F.col(text), F.lit(_STOP)), "")
    return F.transform(F.sequence(F.lit(0), F.length(text)), lambda i: F.array_join(F.slice(chars, i + 1, order + 1), ""))


def _gram_counts(labelled: DataFrame, order: int) -> DataFrame:
    """(gram, n_allow, n_block) for every gram of 1 to ``order`` + 1 characters.
    Only the longest are counted in the texts; the others are their sums."""
    long = labelled.select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(
        *(F.count_if(F.col("label") == c).alias(f"n_{c}") for c in CLASSES)
    )
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.substring(F.col("gram"), order + 2 - k, k))
    return long.select(F.explode(suffixes).alias("gram"), *(f"n_{c}" for c in CLASSES)).groupBy("gram").agg(*(F.sum(f"n_{c}").alias(f"n_{c}") for c in CLASSES))


def _context_counts(counts: DataFrame) -> DataFrame:
    """(context, n_..., kinds_...): how often, and by how many different
    characters, a context was followed. The empty context is left out."""
    context = F.substring("gram", F.lit(1), F.length("gram") - 1)
    return counts.where(F.length("gram") > 1).groupBy(context.alias("context")).agg(
        *(F.sum(f"n_{c}").alias(f"all_{c}") for c in CLASSES), *(F.count_if(F.col(f"n_{c}") > 0).alias(f"kinds_{c}") for c in CLASSES)
    )


def gram_ratios(labelled: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio) for each of the ``wanted`` grams: log P(character | context)
    under the allowed URLs less that under the blocked ones."""
    counts = cut_lineage(_gram_counts(labelled, order), "url-grams")
    contexts = cut_lineage(_context_counts(counts), "url-contexts")
    single = F.length("gram") == 1
    sums = counts.where(single).agg(
        F.count("*").alias("kinds"), *(F.sum(f"n_{c}").alias(f"all_{c}") for c in CLASSES), *(F.count_if(F.col(f"n_{c}") > 0).alias(f"kinds_{c}") for c in CLASSES)
    ).first()
    level = F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("k")
    parts = wanted.select(F.col("gram").alias("whole"), level)
    parts = parts.withColumn("gram", F.substring("whole", order + 2 - F.col("k"), F.col("k"))).withColumn("context", F.substring("gram", F.lit(1), F.col("k") - 1))
    parts = parts.join(counts, "gram", "left").join(contexts, "context", "left")
    root = F.col("k") == 1
    columns = [F.coalesce(f"n_{c}", F.lit(0)).cast("double").alias(f"n_{c}") for c in CLASSES]
    for name in ("all", "kinds"):
        columns += [F.when(root, F.lit(float(sums[f"{name}_{c}"] or 0))).otherwise(F.coalesce(f"{name}_{c}", F.lit(0))).cast("double").alias(f"{name}_{c}") for c in CLASSES]
    levels = parts.groupBy("whole").agg(F.array_sort(F.collect_list(F.struct("k", *columns))).alias("levels"))

    def probability(c: str) -> Column:
        # every character that occurs, and one that does not, are equally likely
        # before any context is known
        start = F.lit(1.0 / ((sums["kinds"] or 0) + 1))
        return F.aggregate("levels", start, lambda p, x: F.when(x[f"all_{c}"] > 0, (x[f"n_{c}"] + x[f"kinds_{c}"] * p) / (x[f"all_{c}"] + x[f"kinds_{c}"])).otherwise(p))

    return levels.select(F.col("whole").alias("gram"), (F.log(probability("allow")) - F.log(probability("block"))).alias("ratio"))


def _threshold(scored: DataFrame) -> float:
    """Score at which allowed and blocked URLs are told apart best, both counting
    alike; from a histogram of a fixed size."""
    cell = F.round(F.greatest(F.least("score", F.lit(5.0)), F.lit(-5.0)) * 200).cast("int")
    rows = scored.groupBy(cell.alias("cell")).agg(*(F.count_if(F.col("label") == c).alias(c) for c in CLASSES)).orderBy("cell").collect()
    total = {c: sum(r[c] for r in rows) for c in CLASSES}
    if not all(total.values()):
        return 0.0
    best, at, blocked, allowed = -1.0, [], 0, 0
    for i, r in enumerate(rows):
        # URLs of this cell and above are allowed
        right = blocked / total["block"] + 1 - allowed / total["allow"]
        if right > best + 1e-12:
            best, at = right, []
        if right >= best - 1e-12:
            at.append(((rows[i - 1]["cell"] if i else r["cell"] - 1) + r["cell"]) / 400)
        blocked, allowed = blocked + r["block"], allowed + r["allow"]
    return at[len(at) // 2]


def judge_urls(pages: DataFrame, rules: list[Rule] | None = None, page_id: str = "page_id", url: str = "url", order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per page row; ``score`` is
    null where a rule decides."""
    rules = RULES if rules is None else rules
    host, path = host_and_path(url)
    judged = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("_rule", longest_rule(rules)).withColumn("_text", F.concat("host", "path"))
    # each distinct address once; most pages have their own
    texts = judged.groupBy("_text").agg(F.first("_rule.verdict").alias("label")).withColumn("grams", _grams("_text", order))
    texts = cut_lineage(texts.withColumn("aside", F.crc32("_text") % FOLDS == 0), "url-texts")
    seen = texts.where("label IS NOT NULL AND NOT aside")
    asked = texts.where("label IS NULL OR aside")
    if seen.select("label").distinct().count() < len(CLASSES):
        scored = asked.select("_text", "label", F.lit(0.0).alias("score"))
    else:
        rows = asked.select("_text", F.explode("grams").alias("gram"))
        ratios = cut_lineage(gram_ratios(seen, rows.select("gram").distinct(), order), "url-ratios")
        sums = rows.join(ratios, "gram").groupBy("_text").agg(F.avg("ratio").alias("score"))
        scored = cut_lineage(asked.select("_text", "label").join(sums, "_text"), "url-scores")
    limit = _threshold(scored.where("label IS NOT NULL"))
    by_method = scored.where("label IS NULL").select("_text", "score")
    out = judged.join(by_method, "_text", "left")
    verdict = F.coalesce("_rule.verdict", F.when(F.coalesce("score", F.lit(0.0)) >= limit, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", F.col("_rule.text").alias("rule"), verdict.alias("verdict"), "score")
