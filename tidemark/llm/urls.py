"""URL filter by a tree of path templates, from DataFrame operations only.

Per host, a path is a walk down a tree of segments. Digits become ``{n}``; where a
branch has many children, the rare ones become the wildcard ``*``; children whose
labelled share of blocked pages does not differ from that of their siblings
together are merged into ``+``. A template is rejected when the smoothed share of
blocked among its labelled pages is high. Labels come from rules; pages under a rule
get the rule's verdict, all others the template's.

The tree is grown on counts per distinct template, so a host with a third of all
pages is no more than its templates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

DEPTH = 3  # segments told apart; the last holds the rest of the path
MOST_CHILDREN = 20  # children of a branch before rare ones become a wildcard
RARE = 0.05  # share of the branch under which a child is rare
SUPPORT = 5  # labelled pages a child needs to be compared with its siblings
ERRORS = 2.0  # standard errors within which children are alike
PRIOR = 4.0  # pages by which the overall share smooths a template's
REJECT = 0.8  # smoothed share of blocked pages from which a template is rejected

Rules = Sequence[tuple[str, str]]  # verdict, "host/path"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a url without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _longest_first(rules: Rules) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: -len(r[1]))


def matched_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name in reversed(_longest_first(rules)):
        rule_host, _, rule_path = name.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _segments(path: Column) -> list[Column]:
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "{n}"), "/", DEPTH)
    return [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(f"s{i + 1}") for i in range(DEPTH)]


def _grow(templates: DataFrame, level: int) -> DataFrame:
    """Generalise the segments of one level below the already general ones."""
    parent, segment = ["host", *[f"c{i}" for i in range(1, level)]], f"s{level}"
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    children = templates.groupBy(*parent, segment).agg(*sums)
    whole = children.groupBy(*parent).agg(F.count("*").alias("kids"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "labelled", "blocked")])
    share = F.col("all_blocked") / F.col("all_labelled")
    gap = F.abs(F.col("blocked") / F.col("labelled") - share)
    alike = gap <= ERRORS * F.sqrt(share * (1 - share) / F.col("labelled")) + 1e-9
    name = (
        F.when((F.col("kids") > MOST_CHILDREN) & (F.col("n") < RARE * F.col("all_n")), "*")
        .when((F.col("labelled") >= SUPPORT) & alike, "+")
        .otherwise(F.col(segment))
    )
    named = children.join(whole, parent).select(*parent, segment, name.alias(f"c{level}"))
    return templates.join(named, [*parent, segment])


def judge(pages: DataFrame, rules: Rules, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """``page_id, host, path, rule, verdict`` (``allow`` or ``block``) of every row.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest wins. Null url and url without ``://`` have empty host and path, which
    fit no rule. Without labelled pages every template is allowed; a template that
    no labelled page shares is allowed. Repeated rows are judged alike; an empty
    table gives no rows.
    """
    host, path = host_and_path(pages[f"`{url}`"])
    rows = pages.select(pages[f"`{page_id}`"].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), *_segments(F.col("path")))
    key = ["host", *[f"s{i}" for i in range(1, DEPTH + 1)]]
    templates = rows.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.count("ruled").alias("labelled"),
        F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"),
    )
    tree = templates = written(templates, "templates")
    for level in range(1, DEPTH + 1):
        tree = _grow(tree, level)
    overall = templates.agg((F.sum("blocked") / F.sum("labelled")).alias("overall"))
    general = ["host", *[f"c{i}" for i in range(1, DEPTH + 1)]]
    leaves = tree.groupBy(*general).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + PRIOR * F.col("overall")) / (F.col("labelled") + PRIOR)
    rejected = leaves.crossJoin(F.broadcast(overall))  # one row
    rejected = rejected.where("labelled > 0").where(purity >= REJECT).select(*general)
    out_key = tree.join(rejected, general).select(*key, F.lit(True).alias("rejected"))
    answer = F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow"))
    return rows.join(out_key, key, "left").select("page_id", "host", "path", "rule", answer.alias("verdict"))


def judge_sql(rules: Rules, table: str = "pages") -> str:
    """The same as one DuckDB statement."""
    fits = []
    for kind, name in _longest_first(rules):
        rule_host, _, rule_path = name.partition("/")
        test = f"(host = '{rule_host}' OR host LIKE '%.{rule_host}') AND starts_with(path, '/{rule_path}')"
        fits.append((test, name, kind))
    rule = "CASE " + " ".join(f"WHEN {t} THEN '{n}'" for t, n, _ in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {t} THEN '{k}'" for t, _, k in fits) + " END"
    cut = "string_split(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '{n}', 'g'), '/')"
    names = [f"coalesce(seg[{i}], '') AS s{i}" for i in range(1, DEPTH)]
    names.append(f"coalesce(array_to_string(seg[{DEPTH}:], '/'), '') AS s{DEPTH}")
    key = ", ".join(["host", *[f"s{i}" for i in range(1, DEPTH + 1)]])
    steps = [
        f"""p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
              regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
              FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3)
                                    ELSE '' END AS rest FROM {table}))""",
        f"r AS (SELECT *, {rule} AS rule, {ruled} AS ruled, {cut} AS seg FROM p)",
        f"q AS (SELECT page_id, host, path, rule, ruled, {', '.join(names)} FROM r)",
        f"""t0 AS (SELECT {key}, count(*) AS n, count(ruled) AS labelled,
                count(CASE WHEN ruled = 'block' THEN 1 END) AS blocked FROM q GROUP BY ALL)""",
    ]
    for i in range(1, DEPTH + 1):
        parent = ", ".join(["host", *[f"c{j}" for j in range(1, i)]])
        steps.append(f"""k{i} AS (SELECT {parent}, s{i}, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked
            FROM t{i - 1} GROUP BY ALL)""")
        steps.append(f"""w{i} AS (SELECT {parent}, count(*) AS kids, sum(n) AS all_n, sum(labelled) AS all_labelled,
            sum(blocked) AS all_blocked FROM k{i} GROUP BY ALL)""")
        steps.append(f"""g{i} AS (SELECT {parent}, s{i},
            CASE WHEN kids > {MOST_CHILDREN} AND n < {RARE} * all_n THEN '*'
                 WHEN labelled >= {SUPPORT} AND abs(blocked / labelled - all_blocked / all_labelled) <= {ERRORS}
                      * sqrt(all_blocked / all_labelled * (1 - all_blocked / all_labelled) / labelled) + 1e-9 THEN '+'
                 ELSE s{i} END AS c{i} FROM k{i} JOIN w{i} USING ({parent}))""")
        steps.append(f"t{i} AS (SELECT * FROM t{i - 1} JOIN g{i} USING ({parent}, s{i}))")
    general = ", ".join(["host", *[f"c{i}" for i in range(1, DEPTH + 1)]])
    steps.append(f"""bad AS (SELECT {general} FROM t{DEPTH} GROUP BY ALL HAVING sum(labelled) > 0
        AND (sum(blocked) + {PRIOR} * (SELECT sum(blocked) / sum(labelled) FROM t0)) / (sum(labelled) + {PRIOR}) >= {REJECT})""")
    steps.append(f"out AS (SELECT {key}, true AS rejected FROM t{DEPTH} JOIN bad USING ({general}))")
    return f"""WITH {", ".join(steps)}
        SELECT page_id, host, path, rule,
               coalesce(ruled, CASE WHEN rejected THEN 'block' ELSE 'allow' END) AS verdict
        FROM q LEFT JOIN out USING ({key})"""
