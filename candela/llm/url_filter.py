"""URL filter: host and path rules, and a character language-model ratio for the rest.

Two smoothed variable-order Markov models (Witten-Bell, contexts of up to three symbols)
are counted from the URLs that the rules accept and reject. A URL without a rule is judged
by the mean log likelihood ratio of its symbols against a threshold that separates a fifth
of the ruled URLs, kept out of the counts, best. Everything is DataFrame expressions.

Symbols are a-z, one for digits, four marks, one for the rest and two for the ends: 34, so
a model has at most 34**4 rows of a gram and a number, which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = 34
ORDER = 3
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z as a-z) and path; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as its string, and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def symbols(host: Column, path: Column) -> Column:
    """The string that the models read."""
    plain = F.translate(F.concat(host, path), UPPER, LOWER)
    return F.regexp_replace(F.regexp_replace(plain, "[0-9]", "0"), "[^a-z0./_-]", "?")


def _grams(df: DataFrame, *keep: str) -> DataFrame:
    padded = F.concat(F.lit("^" * ORDER), F.col("symbols"), F.lit("$"))
    df = df.withColumn("padded", padded)
    return df.select(*keep, F.explode(F.expr(f"transform(sequence(1, length(symbols) + 1), i -> substring(padded, i, {ORDER + 1}))")).alias("gram"))


def _log_ratio(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """counts (side, gram, n) of both models; (gram, llr) of the asked grams. Both sides of
    every join here have at most 2 * 34**4 rows."""
    out = asked.crossJoin(counts.sparkSession.createDataFrame([("allow",), ("block",)], "side string")).withColumn("p", F.lit(1.0 / SYMBOLS))
    for k in range(ORDER + 1):
        tail = f"substring(gram, {ORDER + 1 - k}, {k + 1})"
        seen = counts.groupBy("side", F.expr(tail).alias("tail")).agg(F.sum("n").alias("c"))
        context = seen.groupBy("side", F.expr(f"substring(tail, 1, {k})").alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        out = out.withColumn("tail", F.expr(tail)).withColumn("context", F.expr(f"substring(gram, {ORDER + 1 - k}, {k})"))
        out = out.join(seen, ["side", "tail"], "left").join(context, ["side", "context"], "left")
        smooth = (F.coalesce("c", F.lit(0)) + F.col("kinds") * F.col("p")) / (F.col("total") + F.col("kinds"))
        out = out.select("side", "gram", F.when(F.col("total").isNull(), F.col("p")).otherwise(smooth).alias("p"))
    return out.groupBy("gram").agg(F.sum(F.when(F.col("side") == "allow", F.ln("p")).otherwise(-F.ln("p"))).alias("llr"))


def _threshold(ruled: DataFrame) -> DataFrame:
    """One row (threshold): the score in steps of 0.01 with the best balanced accuracy on
    ruled (score, ruled) rows, the smallest in size on ties; 0 without both verdicts."""
    bins = ruled.groupBy(F.floor(F.col("score") * 100).cast("int").alias("bin")).agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b"))
    bins = bins.unionByName(bins.sparkSession.createDataFrame([(0, 0, 0)], "bin int, a long, b long")).groupBy("bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sums = bins.select("bin", F.expr("sum(a) over (order by bin desc) * 1D / nullif(sum(a) over (), 0) + (sum(b) over () - sum(b) over (order by bin desc)) * 1D / nullif(sum(b) over (), 0)").alias("gain"))
    best = sums.agg(F.expr("max_by(bin, struct(gain, -abs(bin), bin))").alias("bin"), F.max("gain").alias("gain"))
    return best.select(F.when(F.col("gain").isNull(), 0.0).otherwise(F.col("bin") / 100).alias("threshold"))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, score): verdict is allow or block, the longest
    fitting rule's or else the models'.

    Null URLs and those without :// have an empty host and path and are judged by the
    models as the empty string; a null id is kept; repeated rows each give a row; other
    columns are ignored. Without ruled URLs of both kinds the threshold is 0 and the models
    know only what they have seen."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "symbols": symbols(F.col("host"), F.col("path"))})
    # a string is learnt once, as its commonest verdict (allow on ties), however many rows have it
    strings = rows.groupBy("symbols").agg(F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b"))
    ruled = F.when((F.col("a") == 0) & (F.col("b") == 0), F.lit(None)).otherwise(F.when(F.col("a") >= F.col("b"), "allow").otherwise("block"))
    fold = F.conv(F.substring(F.md5("symbols"), 1, 4), 16, 10).cast("int") % 5
    strings = stage(strings.select("symbols", ruled.alias("ruled"), (fold == 0).alias("held")), "url-strings")
    counted = stage(_grams(strings, "ruled", "held").groupBy("gram").agg(F.count_if((F.col("ruled") == "allow") & ~F.col("held")).alias("allow"), F.count_if((F.col("ruled") == "block") & ~F.col("held")).alias("block")), "url-grams")
    counts = counted.select("gram", F.expr("stack(2, 'allow', allow, 'block', block) as (side, n)")).where("n > 0")
    ratio = stage(_log_ratio(counts, counted.select("gram")), "url-models")
    scored = _grams(strings, "symbols").join(F.broadcast(ratio), "gram").groupBy("symbols").agg(F.round(F.avg("llr"), 6).alias("score"))
    scored = stage(strings.join(scored, "symbols", "left"), "url-scores")
    threshold = _threshold(scored.where("held and ruled is not null").select("score", "ruled"))
    judged = scored.crossJoin(F.broadcast(threshold)).select("symbols", "score", F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block").alias("by_model"))
    return rows.join(judged, "symbols", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", "by_model").alias("verdict"), "score")


SQL = r"""
with parsed as (
  select page_id, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest from pages
), split_ as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parsed
), rules(what, h, p) as (
  values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), rows_ as (
  select page_id, host, path,
         (select h || p from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
         (select what from rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) order by length(h || p) desc limit 1) as ruled,
         regexp_replace(regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^a-z0./_-]', '?', 'g') as symbols
  from split_
), strings as (
  select symbols, case when sum((ruled is not null)::int) = 0 then null when sum(coalesce((ruled = 'allow')::int, 0)) >= sum(coalesce((ruled = 'block')::int, 0)) then 'allow' else 'block' end as ruled,
         ('0x' || substring(md5(symbols), 1, 4))::int % 5 = 0 as held
  from rows_ group by symbols
), grams as (
  select symbols, ruled, held, substring('^^^' || symbols || '$', i, 4) as gram
  from (select *, unnest(range(1, length(symbols) + 2)) as i from strings)
), asked as (select distinct gram from grams),
counts as (select ruled as side, gram, count(*) as n from grams where ruled is not null and not held group by all),
sides(side) as (values ('allow'), ('block')),
s0 as (select side, substring(gram, 4, 1) as tail, sum(n) as c from counts group by all),
s1 as (select side, substring(gram, 3, 2) as tail, sum(n) as c from counts group by all),
s2 as (select side, substring(gram, 2, 3) as tail, sum(n) as c from counts group by all),
s3 as (select side, gram as tail, sum(n) as c from counts group by all),
c0 as (select side, '' as context, sum(c) as total, count(*) as kinds from s0 group by all),
c1 as (select side, substring(tail, 1, 1) as context, sum(c) as total, count(*) as kinds from s1 group by all),
c2 as (select side, substring(tail, 1, 2) as context, sum(c) as total, count(*) as kinds from s2 group by all),
c3 as (select side, substring(tail, 1, 3) as context, sum(c) as total, count(*) as kinds from s3 group by all),
p0 as (select a.gram, d.side, case when c0.total is null then 1.0::double / 34 else (coalesce(s0.c, 0) + c0.kinds * (1.0::double / 34)) / (c0.total + c0.kinds) end as p
  from asked a cross join sides d left join s0 on s0.side = d.side and s0.tail = substring(a.gram, 4, 1) left join c0 on c0.side = d.side),
p1 as (select p0.gram, p0.side, case when total is null then p else (coalesce(c, 0) + kinds * p) / (total + kinds) end as p
  from p0 left join s1 on s1.side = p0.side and s1.tail = substring(gram, 3, 2) left join c1 on c1.side = p0.side and c1.context = substring(gram, 3, 1)),
p2 as (select p1.gram, p1.side, case when total is null then p else (coalesce(c, 0) + kinds * p) / (total + kinds) end as p
  from p1 left join s2 on s2.side = p1.side and s2.tail = substring(gram, 2, 3) left join c2 on c2.side = p1.side and c2.context = substring(gram, 2, 2)),
p3 as (select p2.gram, p2.side, case when total is null then p else (coalesce(c, 0) + kinds * p) / (total + kinds) end as p
  from p2 left join s3 on s3.side = p2.side and s3.tail = gram left join c3 on c3.side = p2.side and c3.context = substring(gram, 1, 3)),
model as (select gram, sum(case when side = 'allow' then ln(p) else -ln(p) end) as llr from p3 group by gram),
scored as (select symbols, any_value(ruled) as ruled, any_value(held) as held, round(avg(llr), 6) as score from grams join model using (gram) group by symbols),
bins as (
  select bin, sum(a) as a, sum(b) as b from (
    select floor(score * 100)::int as bin, (ruled = 'allow')::int as a, (ruled = 'block')::int as b from scored where held and ruled is not null
    union all select 0, 0, 0) group by bin
), gains as (
  select bin, sum(a) over (order by bin desc)::double / nullif(sum(a) over (), 0) + (sum(b) over () - sum(b) over (order by bin desc))::double / nullif(sum(b) over (), 0) as gain from bins
), best as (
  select case when max(gain) is null then 0.0 else (select bin from gains order by gain desc nulls last, abs(bin), bin desc limit 1) / 100.0 end as threshold from gains
)
select page_id, host, path, rule, coalesce(r.ruled, case when score >= threshold then 'allow' else 'block' end) as verdict, score
from rows_ r join scored using (symbols) cross join best
"""
