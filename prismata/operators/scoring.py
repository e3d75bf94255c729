"""Quality scores, culling plan, preference ranker, covers and poses."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quality(sharpness: Column, focus: Column, exposure: Column, composition: Column) -> Column:
    """.38 sharpness + .32 focus + .22 exposure + .08 composition; without a composition the rest is scaled up. Metrics are log-normalised and capped at 1."""
    unit = lambda x: F.least(F.log10(F.greatest(x, F.lit(0.0)) + 1) / 3.5, F.lit(1.0))
    base = 0.38 * unit(sharpness) + 0.32 * unit(focus) + 0.22 * exposure
    return F.when(composition.isNull(), base / 0.92).otherwise(base + 0.08 * composition)


def exposure_score(dark: Column, bright: Column) -> Column:
    """Shares of clipped dark and bright pixels -> 0 to 1."""
    return F.greatest(F.lit(0.0), 1 - 5 * dark - 5 * bright)


def subject_adjustment(frontal: Column, eyes: Column) -> Column:
    """Pose and eye state as a change of the score: eyes are open, semi-closed or closed; nulls change nothing."""
    pose = F.when(frontal.isNotNull(), F.greatest(F.lit(-0.04), F.least(F.lit(0.04), (frontal - 0.5) * 0.08)))
    eye = F.when(eyes == "closed", -0.15).when(eyes == "semi-closed", -0.05).otherwise(0.0)
    return F.greatest(F.lit(-0.2), F.least(F.lit(0.04), F.coalesce(pose, F.lit(0.0)) + eye))


def eye_state(p_open: Column) -> Column:
    """open from 0.7, semi-closed from 0.3, else closed; null for null."""
    return F.when(p_open >= 0.7, "open").when(p_open >= 0.3, "semi-closed").when(p_open.isNotNull(), "closed")


def pose(right_eye: tuple[Column, Column], left_eye: tuple[Column, Column], nose_x: Column) -> Column:
    """(frontal, roll) from landmarks: the nose's distance from the middle of the eyes over theirs, and the angle of their line; null if the eyes coincide."""
    (rx, ry), (lx, ly) = right_eye, left_eye
    apart = F.sqrt(F.pow(lx - rx, 2) + F.pow(ly - ry, 2))
    off = F.least(F.abs(nose_x - (rx + lx) * 0.5) / apart, F.lit(1.0))
    known = F.struct(F.greatest(F.lit(0.0), 1 - 1.35 * off).alias("frontal"), F.abs(F.degrees(F.atan2(ly - ry, lx - rx))).alias("roll"))
    return F.when((apart > 1.1920929e-07) & (apart < float("inf")) & nose_x.isNotNull(), known)


def cover_score(frontal: Column, roll: Column, sharpness: Column, width: Column, height: Column, confidence: Column) -> Column:
    """How fit a face is as a cover: .48 frontal, .14 level, .18 sharp, .12 large, .08 sure. Unknown poses count as 0.12 and 45 degrees, unknown sharpness as 0.15."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    level = unit(1 - F.coalesce(roll, F.lit(45.0)) / 35)
    size = unit(F.sqrt(width * height) / 0.2)
    return 0.48 * F.coalesce(frontal, F.lit(0.12)) + 0.14 * level + 0.18 * F.coalesce(sharpness, F.lit(0.15)) + 0.12 * size + 0.08 * unit(confidence)


def covers(faces: DataFrame, manual: DataFrame) -> DataFrame:
    """(person_id, face_id): the manual cover if that face is still the person's and confirmed, else the best score (first on ties)."""
    own = faces.filter("review_state = 'confirmed'").groupBy("person_id").agg(F.max(F.struct("score", (-F.col("id")).alias("k"))).alias("b"))
    valid = manual.join(faces.filter("review_state = 'confirmed'").select("person_id", F.col("id").alias("face_id")), ["person_id", "face_id"], "left_semi").select("person_id", "face_id")
    return own.join(valid, "person_id", "left").select("person_id", F.coalesce("face_id", -F.col("b.k")).alias("face_id"))


def adjusted_score(quality_: Column, adjustment: Column, bias: Column, weight: Column) -> Column:
    """The score a plan goes by: pose and eyes first, clamped to 0 to 1; then 0.8 of that and 0.2 of what the ranker makes of it (null bias: no ranker)."""
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality_ + adjustment))
    own = F.when(F.coalesce(adjustment, F.lit(0.0)) == 0, quality_).otherwise(own)
    return F.when(bias.isNull(), own).otherwise(0.8 * own + 0.2 * preference(own, bias, weight))


def cull_plan(rows: DataFrame, soft: float = 100.0) -> DataFrame:
    """rows with score, representative, verdict, reason and factors: of each group the best scored stays, the others go; blurry rows outside groups go; nothing else does, whatever its score.

    rows: id, group_root (null outside groups), path, quality, sharpness, adjustment (of pose
    and eyes), composition (null: unknown), eyes (null: unknown), bias and weight (of the
    ranker, null without one). Of equal scores the smaller id represents. A row of a group is
    never blurry: the groups are made first. factors: (id, impact, value), in the order in
    which they are shown.
    """
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    scored = rows.withColumn("score", adjusted_score(F.col("quality"), F.col("adjustment"), F.col("bias"), F.col("weight")))
    best = scored.filter("group_root IS NOT NULL").groupBy("group_root").agg(F.max(F.struct("score", (-F.col("id")).alias("k"), "path")).alias("b"))
    joined = scored.join(best.select("group_root", (-F.col("b.k")).alias("representative"), F.col("b.path").alias("of"), F.col("b.score").alias("best")), "group_root", "left")
    second = F.col("group_root").isNotNull() & (F.col("id") != F.col("representative"))
    blurry = F.col("group_root").isNull() & (F.col("sharpness") < soft)
    reason = F.when(second, F.concat(F.lit("duplicate_of:"), "of")).when(blurry, "blurry").when(F.col("group_root").isNotNull(), "best_in_group").otherwise("unique")
    goes = second | F.coalesce(blurry, F.lit(False))
    subject = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("quality") + known("adjustment")))
    factor = lambda name, impact, value, given: F.when(given, F.struct(F.lit(name).alias("id"), impact.alias("impact"), value.cast("double").alias("value")))
    context = F.lit("context")
    factors = F.array_compact(
        F.array(
            factor("duplicate", F.lit("reject"), F.col("best"), second),
            factor("sharpness", F.lit("reject"), F.col("sharpness"), blurry),
            factor("technical_quality", F.when(goes, "supporting").otherwise("context"), F.col("score"), F.lit(True)),
            factor("subject_geometry", context, F.col("composition"), F.col("composition").isNotNull()),
            factor("personalization", context, F.col("score") - subject, F.col("bias").isNotNull()),
            factor("face_pose_adjustment", context, subject - F.col("quality"), known("adjustment") != 0),
            factor("eye_state", F.when(F.col("eyes") == "closed", "reject").when(F.col("eyes") == "semi-closed", "supporting").otherwise("context"), F.lit(None), F.col("eyes").isNotNull()),
        )
    )
    return joined.withColumn("reason", reason).withColumn("verdict", F.when(goes, "reject").otherwise("keep")).withColumn("factors", factors).drop("of", "best")


def preference(quality_: Column, bias: Column, weight: Column) -> Column:
    """The ranker's probability that a row of this quality is kept."""
    return 1 / (1 + F.exp(-(bias + weight * F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality_)))))


#: The ranker: passes, step, weight decay, newest rows used and rows needed.
EPOCHS, RATE, DECAY, NEWEST, NEEDED = 80, 0.08, 0.01, 5_000, 200


def ranker_examples(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """(seq, quality, keep): what users changed, the NEWEST of it. events: id, decision_id, next_status, source. decisions: id, quality_score."""
    own = events.filter("source = 'user'").select(F.col("id").alias("seq"), F.col("decision_id"), (F.col("next_status") == "keep").alias("keep"))
    joined = own.join(decisions.select(F.col("id").alias("decision_id"), F.col("quality_score").alias("quality")), "decision_id")
    return joined.select("seq", "quality", "keep").orderBy(F.desc("seq"), "quality", "keep").limit(NEWEST)


def fit_ranker(feedback: DataFrame) -> DataFrame:
    """(bias, weight, examples): one-feature logistic model by sequential gradient steps, newest first; no row below NEEDED examples.

    feedback: seq, quality, keep. At most NEWEST rows, by definition of the model, meet in one task.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["seq", "quality", "keep"], ascending=[False, True, True], kind="stable")
        x, y = pdf["quality"].clip(0, 1).to_numpy(float), pdf["keep"].to_numpy(float)
        if len(x) < NEEDED:
            return pd.DataFrame({"bias": [], "weight": [], "examples": []}).astype({"bias": float, "weight": float, "examples": "int64"})
        b, w = 0.0, 1.0
        for _ in range(EPOCHS):
            for xi, yi in zip(x.tolist(), y.tolist()):
                e = yi - 1.0 / (1.0 + float(np.exp(-(b + w * xi))))
                b += RATE * e
                w += RATE * (e * xi - DECAY * w)
        return pd.DataFrame({"bias": [b], "weight": [w], "examples": [len(x)]})

    newest = feedback.select("seq", "quality", F.col("keep").cast("double").alias("keep")).orderBy(F.desc("seq"), "quality", "keep").limit(NEWEST).withColumn("model", F.lit(0))
    return newest.groupBy("model").applyInPandas(run, "bias double, weight double, examples bigint")


def rank(rows: DataFrame, model: DataFrame) -> DataFrame:
    """rows with personal: the model's probability, null without a model."""
    p = preference(F.col("quality"), F.col("bias"), F.col("weight"))
    return rows.join(F.broadcast(model.limit(1)), how="left").withColumn("personal", p).drop("bias", "weight", "examples")
