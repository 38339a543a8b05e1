"""Queries of what sources report, leave out and stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.operators import corroboration as C
from attestor.operators import positions as P
from attestor.plans.durable import durable, small
from attestor.plans.q_corroboration import OWNERS, owners
from attestor.plans.registry import query
from attestor.plans.tables import Tables

COVERAGE = """rd AS (SELECT DISTINCT story_id, canonical_id AS item, grp AS unit FROM v_claims JOIN v_outlets USING (article_id) JOIN grp3 USING (article_id) WHERE text_source <> 'summary' AND NOT starts_with(grp, 'gov:')),
us AS (SELECT DISTINCT story_id, unit FROM rd), w3 AS (SELECT story_id FROM us GROUP BY story_id HAVING count(*) >= 3), fc AS (SELECT story_id, item FROM rd JOIN w3 USING (story_id) GROUP BY ALL HAVING count(*) >= 2),
cv AS (SELECT fc.story_id, fc.item, us.unit, rd.item IS NOT NULL AS told FROM fc JOIN us ON fc.story_id = us.story_id LEFT JOIN rd ON rd.story_id = fc.story_id AND rd.item = fc.item AND rd.unit = us.unit)"""


def coverage_of(t: Tables) -> DataFrame:
    """What the units of every story report and leave out."""
    read = t.v_outlets.where("text_source <> 'summary'").select("article_id").join(owners(t), "article_id").where(~F.col("grp").startswith("gov:"))
    return C.coverage(t.v_claims.join(small(read), "article_id").select("story_id", F.col("canonical_id").alias("item"), F.col("grp").alias("unit")))


@query("coverage_omission", f"WITH {OWNERS}, {COVERAGE} SELECT story_id, unit, coalesce(string_agg(item, ',' ORDER BY item) FILTER (told), '') AS reported, coalesce(string_agg(item, ',' ORDER BY item) FILTER (NOT told), '') AS omitted FROM cv GROUP BY ALL")
def _(t: Tables):
    listed = lambda told: F.array_join(F.array_sort(F.collect_list(F.when(F.col("told") == told, F.col("item")))).cast("array<string>"), ",")
    return coverage_of(t).groupBy("story_id", "unit").agg(listed(True).alias("reported"), listed(False).alias("omitted"))


ITEMS = f"""{OWNERS}, {COVERAGE}, cl AS (SELECT story_id, canonical_id AS item, grp AS unit, stance, loaded_word, attributed_to FROM v_claims JOIN grp3 USING (article_id)),
wide AS (SELECT story_id FROM cl GROUP BY story_id HAVING count(DISTINCT unit) >= 3), cw AS (SELECT * FROM cl WHERE story_id IN (SELECT story_id FROM wide)),
an AS (SELECT story_id, item, unit, min(CASE WHEN stance = 'denies' THEN 0 ELSE 1 END) AS y FROM cw GROUP BY ALL), sp AS (SELECT story_id, item, count(*) AS n, sum(y) AS ones FROM an GROUP BY ALL),
os AS (SELECT story_id, item FROM cv GROUP BY ALL HAVING count(*) >= 3 AND count(*) FILTER (told) >= 1 AND count(*) FILTER (NOT told) >= 1),
fw AS (SELECT DISTINCT story_id, item, loaded_word AS word, unit FROM cw), fr AS (SELECT fw.story_id, fw.item, word FROM fw JOIN sp ON sp.story_id = fw.story_id AND sp.item = fw.item GROUP BY fw.story_id, fw.item, word, n HAVING n >= 3 AND count(*) < n),
qu AS (SELECT DISTINCT story_id, unit, name AS voice FROM cw JOIN v_attributions USING (attributed_to) WHERE kind IN ('police', 'government', 'court', 'person')),
qn AS (SELECT story_id, count(DISTINCT unit) AS n FROM qu GROUP BY story_id HAVING count(DISTINCT unit) >= 3), vo AS (SELECT qu.story_id, voice FROM qu JOIN qn ON qu.story_id = qn.story_id GROUP BY qu.story_id, voice, n HAVING count(*) < n),
it AS (SELECT an.story_id, 'stance' AS type, an.item::VARCHAR AS item, unit, y FROM an JOIN sp ON an.story_id = sp.story_id AND an.item = sp.item AND n >= 2 AND ones BETWEEN 1 AND n - 1
UNION ALL SELECT cv.story_id, 'omission', cv.item::VARCHAR, unit, CASE WHEN told THEN 1 ELSE 0 END FROM cv JOIN os ON cv.story_id = os.story_id AND cv.item = os.item
UNION ALL SELECT fr.story_id, 'framing', concat(fr.item::VARCHAR, ' ', fr.word), an.unit, CASE WHEN fw.unit IS NULL THEN 0 ELSE 1 END FROM fr JOIN an ON fr.story_id = an.story_id AND fr.item = an.item LEFT JOIN fw ON fw.story_id = fr.story_id AND fw.item = fr.item AND fw.word = fr.word AND fw.unit = an.unit
UNION ALL SELECT vo.story_id, 'voices', vo.voice, u.unit, CASE WHEN qu.unit IS NULL THEN 0 ELSE 1 END FROM vo JOIN (SELECT DISTINCT story_id, unit FROM qu) u ON vo.story_id = u.story_id LEFT JOIN qu ON qu.story_id = vo.story_id AND qu.voice = vo.voice AND qu.unit = u.unit)"""


def items_of(t: Tables) -> DataFrame:
    """The items of all stories; own words and unnamed or unresolved sources are no voices."""
    rows = t.v_claims.join(small(owners(t)), "article_id").select("story_id", F.col("canonical_id").alias("item"), F.col("grp").alias("unit"), (F.col("stance") == "denies").alias("denies"), F.col("loaded_word").alias("word"), "attributed_to")
    named = small(durable(t.v_attributions.where("kind IN ('police', 'government', 'court', 'person')").select("attributed_to", F.col("name").alias("voice")), "attributions"))
    return P.position_items(rows, coverage_of(t), rows, rows.join(named, "attributed_to"))


@query("position_items", f"WITH {ITEMS} SELECT story_id, type, item, unit, y FROM it")
def _(t: Tables):
    return items_of(t)


@query("ideal_points")
def _(t: Tables):
    return P.ideal_points(items_of(t))


@query("ideal_points_step", f"""WITH {ITEMS}, un AS (SELECT unit, (('0x' || substr(md5(unit), 1, 8))::BIGINT / 4294967296.0::DOUBLE) AS x FROM it GROUP BY unit HAVING count(*) >= {P.LEAST_ANSWERS}),
th AS (SELECT unit, (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS t FROM un), ob AS (SELECT concat_ws('|', story_id, type, item) AS i, unit, t, y FROM it JOIN th USING (unit)),
sm AS (SELECT i, sum(y - 0.5::DOUBLE) AS ga, sum((y - 0.5::DOUBLE) * t) AS gb, count(*) / 4.0 + {P.HOLD_A} AS aa, sum(t) / 4.0 AS ab, sum(t * t) / 4.0 + {P.HOLD_B} AS bb FROM ob GROUP BY i),
pa AS (SELECT i, greatest(-2.0, least(2.0, (bb * ga - ab * gb) / (aa * bb - ab * ab))) AS a, greatest(-2.0, least(2.0, (aa * gb - ab * ga) / (aa * bb - ab * ab))) AS b FROM sm),
pr AS (SELECT unit, t, y, b, 1 / (1 + exp(-(a + b * t))) AS p FROM ob JOIN pa USING (i)), gr AS (SELECT unit, any_value(t) AS t, sum((y - p) * b) AS g, sum(p * (1 - p) * b * b) AS h FROM pr GROUP BY unit),
ou AS (SELECT *, avg(g * t) OVER () AS o, avg(g) OVER () AS m FROM gr), mv AS (SELECT unit, t + (g - m - o * t) / (h + greatest(o, 0.0) + 1e-9) AS x FROM ou)
SELECT unit, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS theta FROM mv""")
def _(t: Tables):
    return P.first_step(items_of(t)).withColumn("theta", F.round("theta", 6))


@query("position_test")
def _(t: Tables):
    return P.position_test(items_of(t))
