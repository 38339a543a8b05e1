"""The tables of a scale factor, and views that read them as articles, claims, outlets and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: One SQL text for each view, valid in Spark and in DuckDB.
VIEWS = {
    "v_articles": """SELECT doc_id AS article_id, source AS outlet, CAST(substring(source, 4) AS INT) AS outlet_no,
  concat('own', CAST(CAST(substring(source, 4) AS INT) % 7 AS STRING)) AS owner, CASE WHEN source = 'src3' THEN 'union' END AS government,
  CASE WHEN doc_id % 11 = 0 THEN 'PTI' WHEN doc_id % 13 = 0 THEN 'ANI' END AS agency, lang, substring(text, 1, 80) AS title, text, n_chars,
  CASE WHEN n_chars < 400 THEN 'summary' ELSE 'full' END AS text_source,
  CASE WHEN doc_id % 3 = 0 THEN 'Staff Reporter' ELSE concat('Author ', CAST(doc_id % 17 AS STRING)) END AS author,
  CAST(TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '3' MINUTE AS TIMESTAMP) AS published_at, CAST(floor(doc_id / 8) AS BIGINT) AS story_id FROM documents""",
    "v_claims": """SELECT l_orderkey * 10 + l_linenumber AS claim_id, l_partkey % 500 AS story_id, l_suppkey AS article_id,
  (l_partkey % 500) * 100 + l_orderkey % 29 AS canonical_id, CASE WHEN l_linenumber % 3 = 0 THEN 'event' ELSE 'claim' END AS kind,
  CASE WHEN l_returnflag = 'N' THEN 'attributes' WHEN l_returnflag = 'R' AND l_orderkey % 29 % 3 = 0 THEN 'denies' ELSE 'asserts' END AS stance,
  CASE l_linenumber WHEN 1 THEN 'none' WHEN 2 THEN 'official_statement' WHEN 3 THEN 'named_witness' WHEN 4 THEN 'unnamed_source'
    WHEN 5 THEN 'fir' WHEN 6 THEN 'video' ELSE 'court_record' END AS evidence,
  CASE l_orderkey % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'police' WHEN 2 THEN 'sources' WHEN 3 THEN 'PTI' ELSE concat('person ', CAST(l_orderkey % 9 AS STRING)) END AS attributed_to,
  concat('w', CAST(l_partkey % 23 AS STRING)) AS loaded_word, CAST(l_shipdate AS TIMESTAMP) AS t_start,
  CAST(l_shipdate + CAST(l_quantity AS INT) * INTERVAL '1' HOUR AS TIMESTAMP) AS t_end FROM lineitem""",
    "v_outlets": """SELECT s_suppkey AS article_id, s_name AS outlet, concat('own', CAST(s_nationkey AS STRING)) AS owner,
  CASE WHEN n_regionkey = 4 AND s_nationkey % 2 = 0 THEN lower(n_name) END AS government,
  CASE WHEN s_suppkey % 10 = 0 AND s_nationkey % 6 = 1 THEN 'PTI' END AS agency, CASE WHEN s_suppkey % 8 < 2 THEN CAST(floor(s_nationkey / 3) AS BIGINT) END AS wire_group,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Staff Reporter' ELSE concat('Author ', CAST(s_suppkey % 17 AS STRING)) END AS author,
  CASE WHEN s_suppkey % 6 = 5 THEN 'summary' ELSE 'full' END AS text_source, CASE WHEN s_suppkey % 4 = 1 THEN 'NEW DELHI: two people died.' ELSE 'Also Read: two people died.' END AS text,
  CAST(TIMESTAMP '2024-01-01 00:00:00' + s_suppkey * INTERVAL '3' MINUTE AS TIMESTAMP) AS published_at FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "v_attributions": """SELECT attributed_to, CASE attributed_to WHEN 'person 0' THEN 'Supplier#000000003' WHEN 'person 2' THEN 'High Court' ELSE attributed_to END AS name,
  CASE attributed_to WHEN 'police' THEN 'police' WHEN 'person 1' THEN 'government' WHEN 'person 2' THEN 'court' WHEN 'person 3' THEN 'anonymous' WHEN 'person 4' THEN CAST(NULL AS STRING) ELSE 'person' END AS kind,
  CASE WHEN attributed_to = 'person 1' THEN 'Union' END AS source_government
  FROM (SELECT DISTINCT CASE l_orderkey % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'police' WHEN 2 THEN 'sources' WHEN 3 THEN 'PTI' ELSE concat('person ', CAST(l_orderkey % 9 AS STRING)) END AS attributed_to FROM lineitem) AS raw""",
    "v_statements": """SELECT canonical_id, min(story_id) AS story_id, CASE WHEN canonical_id % 6 = 0 THEN CAST(NULL AS BOOLEAN) ELSE canonical_id % 5 <> 0 END AS checkable,
  CASE WHEN canonical_id % 2 = 0 THEN CAST(TIMESTAMP '2024-01-01 00:00:00' AS TIMESTAMP) END AS met_at, canonical_id % 13 = 0 AS name_conflict, CASE WHEN min(story_id) % 3 = 0 THEN 'global' END AS mode,
  CASE WHEN canonical_id % 11 = 0 THEN 'confirmed' WHEN canonical_id % 17 = 0 THEN 'false' END AS old_verdict, CAST(CASE WHEN canonical_id % 3 = 0 THEN count(*) ELSE 3 END AS BIGINT) AS checked_members
  FROM (SELECT l_partkey % 500 AS story_id, (l_partkey % 500) * 100 + l_orderkey % 29 AS canonical_id FROM lineitem) AS told GROUP BY canonical_id""",
    "v_feed_log": """SELECT event_id AS log_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS feed_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS ok FROM events""",
    "v_follows": """SELECT DISTINCT user_id AS reader, CASE event_type WHEN 'click' THEN 'section' WHEN 'view' THEN 'place' WHEN 'signup' THEN 'entity' ELSE 'story' END AS kind,
  CAST(CASE WHEN event_type IN ('click', 'view', 'signup') THEN user_id ELSE event_id % 97 END AS STRING) AS follow_key FROM events WHERE event_type <> 'error'""",
    "v_word_follows": """SELECT DISTINCT e.user_id AS reader, regexp_extract(d.text, '^[^ ]+ +([^ ]+ [^ ]+) ', 1) AS phrase FROM events e JOIN documents d ON d.doc_id = e.user_id WHERE e.event_type = 'signup'
  UNION SELECT DISTINCT user_id AS reader, concat('author ', CAST(user_id % 23 AS STRING)) AS phrase FROM events WHERE event_type = 'signup' AND user_id % 3 = 0""",
    "v_links": """SELECT o_orderkey AS child_id, CAST(floor(o_orderkey / 2) AS BIGINT) AS parent_id FROM orders WHERE o_orderkey > 1 AND o_orderkey % 3 <> 0""",
    "v_told": """SELECT d.doc_id AS statement_id, CAST(floor(d.doc_id / 8) AS BIGINT) AS story_id, CASE d.doc_id % 8 WHEN 0 THEN o.own WHEN 1 THEN concat(o.own, ', officials said!') WHEN 2 THEN concat(o.own, ' near the market under heavy rain')
  WHEN 3 THEN concat(o.own, ' in another case near the market') WHEN 4 THEN concat(o.own, ', which never happened') WHEN 5 THEN concat(o.own, ' with 12 people on 5 March 2021') WHEN 6 THEN concat(o.own, ' with 15 people on 5 March 2021')
  ELSE concat(regexp_extract(o.own, '^(""" + " ".join(["[^ ]+"] * 9) + """)', 1), ' yields tall ships') END AS text FROM documents d JOIN (SELECT doc_id, regexp_extract(text, '^(""" + " ".join(["[^ ]+"] * 12) + """)', 1) AS own FROM documents) o ON o.doc_id = CAST(floor(d.doc_id / 8) AS BIGINT) * 8""",
    "v_relations": """SELECT l_partkey % 500 AS story_id, (l_partkey % 500) * 100 + l_orderkey % 29 AS earlier, (l_partkey % 500) * 100 + l_suppkey % 29 AS later FROM lineitem WHERE l_linenumber = 6 AND l_quantity <= 5""",
    "v_runs": """SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS started_at, count(*) AS ingested, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS grouped_n
  FROM events GROUP BY date_trunc('hour', CAST(ts AS TIMESTAMP))""",
}
BASE = {"v_articles": ["documents"], "v_claims": ["lineitem"], "v_outlets": ["supplier", "nation"], "v_attributions": ["lineitem"], "v_statements": ["lineitem"], "v_feed_log": ["events"], "v_follows": ["events"], "v_word_follows": ["events", "documents"], "v_links": ["orders"], "v_relations": ["lineitem"], "v_told": ["documents"], "v_runs": ["events"]}


class Tables:
    """Attribute access to tables and views: ``Tables(spark, dir).orders``, ``.v_claims``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = VIEWS[name].replace("concat(", "concat_ws('', ")  # DuckDB's concat leaves nulls out
        for base in BASE[name]:
            text = text.replace(f"FROM {base}", f"FROM {{{base}}}").replace(f"JOIN {base}", f"JOIN {{{base}}}")
        return self.spark.sql(text, **{base: getattr(self, base) for base in BASE[name]})


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names put in front."""
    named = [v for v in VIEWS if v in sql]
    if not named:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in named)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
