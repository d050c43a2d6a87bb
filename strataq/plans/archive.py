"""Quality-diversity archives on the driver's tables: parts are candidates, brands are cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import archive as A
from .base import query
from .scoring import rounded

OBJECTIVES = [("p_retailprice", 900.0, 2000.0, "maximize", 2.0), ("p_size", 1.0, 45.0, "minimize", 1.0)]
_SCORE = "(2 * (least(greatest(p_retailprice, 900), 2000) - 900) / 1100 + 1 - (least(greatest(p_size, 1), 45) - 1) / CAST(44 AS DOUBLE)) / 3"


@query("scalarize", f"SELECT p_partkey, round({_SCORE}, 8) AS score, CAST(CASE WHEN p_retailprice < 900 OR p_retailprice > 2000 THEN 1 ELSE 0 END + CASE WHEN p_size < 1 OR p_size > 45 THEN 1 ELSE 0 END AS INTEGER) AS clipped FROM part")
def scalarize(t):
    score, clipped = A.scalarize(OBJECTIVES)
    return rounded(t.part.select("p_partkey", score.alias("score"), clipped.alias("clipped")), "score", places=8)


_ADMIT = """c AS (SELECT p_partkey AS id, p_brand AS cell, p_retailprice AS x, p_size AS y, p_size < 48 AS ok FROM part), f AS (SELECT * FROM c WHERE ok),
o AS (SELECT f.*, EXISTS (SELECT 1 FROM f g WHERE g.cell = f.cell AND g.id < f.id AND g.x >= f.x AND g.y <= f.y AND (g.x > f.x OR g.y < f.y)) AS lost, EXISTS (SELECT 1 FROM f g WHERE g.cell = f.cell AND g.id < f.id AND g.x <= f.x AND g.y >= f.y AND (g.x < f.x OR g.y > f.y) AND NOT EXISTS (SELECT 1 FROM f h WHERE h.cell = f.cell AND h.id < f.id AND h.x >= g.x AND h.y <= g.y AND (h.x > g.x OR h.y < g.y))) AS won, min(id) OVER (PARTITION BY cell) AS first FROM f)"""


@query("archive_outcomes", f"WITH {_ADMIT} SELECT cell, outcome, count(*) AS n FROM (SELECT cell, CASE WHEN lost THEN 'dominated_rejected' WHEN id = first THEN 'new_cell' WHEN won THEN 'dominates_existing' ELSE 'nondominated_added' END AS outcome FROM o UNION ALL SELECT cell, 'infeasible' FROM c WHERE NOT ok) GROUP BY 1, 2")
def archive_outcomes(t):
    c = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cell"), F.col("p_partkey").alias("added"), (F.col("p_size") < 48).alias("feasible"), "p_retailprice", "p_size")
    return A.admit(c, OBJECTIVES, capacity=10**6).groupBy("cell", "outcome").agg(F.count("*").alias("n"))


def front(t):
    score, _ = A.scalarize(OBJECTIVES)
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cell"), F.round(score, 8).alias("score"), (F.col("p_size") % 5).alias("visits"))


@query("select_parents", f"SELECT id, cell, score, visits, CAST(row_number() OVER (ORDER BY visits, score DESC, id) AS INTEGER) AS place FROM (SELECT p_partkey AS id, p_brand AS cell, round({_SCORE}, 8) AS score, p_size % 5 AS visits FROM part) QUALIFY row_number() OVER (ORDER BY visits, score DESC, id) <= 12")
def select_parents(t):
    return A.select_parents(front(t), 12)


@query("archive_round_trip", f"SELECT p_brand AS cell, p_partkey AS id, round({_SCORE}, 8) AS score FROM part")
def archive_round_trip(t):
    return A.restore(A.snapshot(front(t)))
