"""URL filter by rules and a character language-model ratio, with DataFrame and SQL functions only.

Rules judge the URLs they fit. All other URLs are judged by two smoothed variable-order Markov
models over folded URL characters, one learnt from the URLs that rules allow and one from those
that rules block. A URL's score is the mean, over its characters, of the difference of the two
log-likelihoods; the cut is calibrated on rule-judged URLs that the models did not see: of the cuts
with the best balanced accuracy the lowest, half-way to the next score below.

Characters fold to 32 symbols, contexts have up to 3 symbols, so the model has at most 32^4 rows
whatever the input: that is the proven bound of what is broadcast (about 1 M rows of 16 bytes).
A context that fewer than MIN_CONTEXT training characters followed falls back to the shorter one.

Defined cases: null URLs and URLs without '://' have an empty host and path and no rule; a null or
empty URL has no characters and is allowed. Repeated rows are judged alike, one output row each.
Without training rows of one class the cut is 0 and ties are allowed. No pages give no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tracklake.llm.common import save

#: (verdict, host, path): the rule fits the host and its subdomains where the path starts so.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SYMBOLS = "^abcdefghijklmnopqrstuvwxyz0/.-_"
MIN_CONTEXT = 16
WEIGHT = 4.0
#: Score bins for one unit of log-likelihood difference.
BINS = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Occurrences of each four-symbol window in the training URLs of each class; 0 for windows only seen elsewhere.
COUNTED = """SELECT g, sum(CASE WHEN said = 'allow' AND NOT held THEN n ELSE 0 END) * 1.0e0 AS na,
    sum(CASE WHEN said = 'block' AND NOT held THEN n ELSE 0 END) * 1.0e0 AS nr FROM coded GROUP BY g"""


def _rules(rules) -> tuple[str, str]:
    """CASE expressions for the longest fitting rule and its verdict."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rule, verdict = [], []
    for what, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = f"WHEN (host = {quote(host)} OR right(host, {len(host) + 1}) = {quote('.' + host)}) AND left(path, {len(path)}) = {quote(path)} THEN "
        rule.append(fits + quote(host + path))
        verdict.append(fits + quote(what))
    return (f"CASE {' '.join(rule)} END", f"CASE {' '.join(verdict)} END") if rule else ("CAST(NULL AS STRING)", "CAST(NULL AS STRING)")


def sql(duck: bool = False, rules=RULES, pages: str = "pages", grams: str = "", parts: int = 1) -> str:
    """The whole judgement as SQL; duck: in DuckDB's dialect; grams: a table to read the n-gram counts from.

    parts: URLs are dealt to so many tasks before each becomes a row a character, which small tables need most.
    """
    rule, verdict = _rules(rules)
    digits = "translate(translate(url, '" + UPPER + "', '" + LOWER + "'), '123456789', '000000000')"
    fold = f"regexp_replace({digits}, '[^a-z0/.-]', '_', 'g')" if duck else f"regexp_replace({digits}, '[^a-z0/.-]', '_')"
    spread = "unnest(range(1, length(folded) - 2))" if duck else "explode(sequence(1, length(folded) - 3))"
    symbol = lambda k: f"(instr('{SYMBOLS}', substr(folded, i + {k}, 1)) - 1)"
    div = (lambda n: f"g // {n}") if duck else (lambda n: f"g div {n}")
    hint = "" if duck else "/*+ BROADCAST(model) */"
    dealt = "" if duck else f"/*+ REPARTITION({parts}, url, folded) */"
    held = "substr(md5(url), 1, 1) IN ('0', '1', '2', '3')"

    def order(k: int) -> str:
        """Interpolated probabilities of order k for both classes from those of order k - 1."""
        at, ctx = 32 ** (k + 1), 32**k
        return f"""
  g{k}n AS (SELECT g % {at} AS g, sum(na) AS na, sum(nr) AS nr FROM grams GROUP BY g % {at}),
  c{k} AS (SELECT {div(32)} AS ctx, sum(na) AS ca, sum(nr) AS cr FROM g{k}n GROUP BY {div(32)}),
  p{k} AS (SELECT n.g, CASE WHEN ca + cr >= {MIN_CONTEXT} THEN (na + {WEIGHT} * pa) / (ca + {WEIGHT}) ELSE pa END AS pa,
      CASE WHEN ca + cr >= {MIN_CONTEXT} THEN (nr + {WEIGHT} * pr) / (cr + {WEIGHT}) ELSE pr END AS pr
    FROM g{k}n n JOIN c{k} ON ctx = {div(32).replace("g", "n.g", 1)} JOIN p{k - 1} p ON p.g = n.g % {ctx}),"""

    return f"""
WITH cut_up AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM {pages}),
  parts AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut_up),
  ruled AS (SELECT page_id, url, host, path, {rule} AS rule, {verdict} AS said FROM parts),
  urls AS (SELECT url, max(said) AS said, count(*) AS n, concat('^^^', {fold}) AS folded, {held} AS held FROM ruled WHERE length(url) > 0 GROUP BY url),
  dealt AS (SELECT {dealt} url, said, n, held, folded FROM urls),
  places AS (SELECT url, said, n, held, folded, {spread} AS i FROM dealt),
  coded AS (SELECT url, said, n, held, ((({symbol(0)} * 32 + {symbol(1)}) * 32 + {symbol(2)}) * 32 + {symbol(3)}) AS g FROM places),
  grams AS ({grams and f"SELECT * FROM {grams}" or COUNTED}),
  total AS (SELECT sum(na) AS ta, sum(nr) AS tr FROM grams),
  p0 AS (SELECT g % 32 AS g, (sum(na) + 1) / ((SELECT ta FROM total) + 32) AS pa, (sum(nr) + 1) / ((SELECT tr FROM total) + 32) AS pr FROM grams GROUP BY g % 32),
  {order(1)}{order(2)}{order(3)}
  model AS (SELECT g, ln(pa) - ln(pr) AS w FROM p3),
  scored AS (SELECT {hint} url, max(said) AS said, max(n) AS n, max(CASE WHEN held THEN 1 ELSE 0 END) AS held, CAST(floor(round(avg(w), 9) * {BINS}) AS BIGINT) AS bin
    FROM coded JOIN model ON coded.g = model.g GROUP BY url),
  bins AS (SELECT bin, sum(CASE WHEN said = 'allow' THEN n ELSE 0 END) AS na, sum(CASE WHEN said = 'block' THEN n ELSE 0 END) AS nr
    FROM scored WHERE held = 1 AND said IS NOT NULL GROUP BY bin),
  sides AS (SELECT bin, lag(bin) OVER (ORDER BY bin) AS prev, (1.0e0 - coalesce(sum(na) OVER before, 0) * 1.0e0 / nullif(sum(na) OVER everything, 0)) + coalesce(sum(nr) OVER before, 0) * 1.0e0 / nullif(sum(nr) OVER everything, 0) AS good
    FROM bins WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), everything AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  cut AS (SELECT coalesce(min(CAST(ceil((bin + coalesce(prev, bin)) / 2.0e0) AS BIGINT)), 0) AS bin FROM sides WHERE good = (SELECT max(good) FROM sides))
SELECT r.page_id, r.host, r.path, r.rule, CASE WHEN r.said IS NOT NULL THEN r.said WHEN s.bin < (SELECT bin FROM cut) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN scored s ON r.url = s.url"""


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages (page_id, url)."""
    spark, pages = pages.sparkSession, pages.select("page_id", "url")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    head = sql(rules=rules, pages="{pages}", parts=parts).partition("  total AS (")[0].rstrip().rstrip(",")
    grams = save(spark.sql(head + " SELECT * FROM grams", pages=pages), "grams")
    return spark.sql(sql(rules=rules, pages="{pages}", grams="{grams}", parts=parts), pages=pages, grams=grams)
