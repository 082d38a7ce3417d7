"""Colour gains from star colours, their guards, and the strength at which they leave the background calm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.robust import MAD_TO_SIGMA, clip, smoothstep
from starloom.operators.joins import repeated_median

STRENGTHS = (1.0, 0.85, 0.7, 0.55, 0.4, 0.25, 0.15, 0.1, 0.05, 0.02, 0.0)  # fixed values of the damping grid


def gains(stars: DataFrame, k_max: float = 3.0, max_condition: float = 3.0, max_rms: float = 0.35, least: int = 3) -> DataFrame:
    """Diagonal gains (green is 1) of each frame from stars(frame_id, id, img_r, img_b, cat_r, cat_b), all ratios to green.

    A line through (catalog, image) by repeated medians is read at the median catalog colour; the gain is its inverse.
    reason is the first guard that failed: few stars, determinant, condition, residual; null where the gains hold.
    Nothing is rounded. A frame holds a bounded list of stars (the brightest), so the pairs inside it are bounded too.
    """
    good = stars.where("img_r > 0 and img_b > 0 and cat_r > 0 and cat_b > 0")
    both = good.select("frame_id", "id", F.explode(F.create_map(F.lit("r"), F.struct(F.col("cat_r").alias("x"), F.col("img_r").alias("y")), F.lit("b"), F.struct(F.col("cat_b").alias("x"), F.col("img_b").alias("y")))).alias("c", "s"))
    points = both.select(F.struct("frame_id", "c").alias("key"), "id", "s.x", "s.y")
    line = repeated_median(points, "key")
    white = points.groupBy("key").agg(F.median("x").alias("white"), F.count("*").alias("n"))
    k = clip(F.try_divide(F.lit(1.0), F.col("intercept") + F.col("slope") * F.col("white")), 1e-3, k_max)
    k = line.join(white, "key").withColumn("k", k)
    off = F.ln("x") - F.ln(F.col("k") * F.col("y"))
    each = points.join(k.select("key", "k", "n"), "key").withColumn("d", off).withColumn("m", F.median("d").over(Window.partitionBy("key")))
    each = each.groupBy("key").agg(F.first("k").alias("k"), F.first("n").alias("n"), (MAD_TO_SIGMA * F.median(F.abs(F.col("d") - F.col("m")))).alias("rms"))
    of = lambda c, v: F.max(F.when(F.col("key.c") == c, F.col(v)))
    out = each.groupBy(F.col("key.frame_id").alias("frame_id")).agg(of("r", "k").alias("kr"), of("b", "k").alias("kb"), F.max("n").alias("n_stars"), F.max("rms").alias("rms"))
    out = out.withColumn("determinant", F.col("kr") * F.col("kb")).withColumn("condition", F.greatest("kr", F.lit(1.0), "kb") / F.least("kr", F.lit(1.0), "kb"))
    reason = F.when(F.col("n_stars") < least, "few stars").when(F.coalesce(F.col("determinant") <= 0, F.lit(True)), "determinant")
    return out.withColumn("reason", reason.when(F.col("condition") > max_condition, "condition").when(F.col("rms") > max_rms, "residual"))


def attenuated(v: Column, k: Column, low: float, high: float) -> Column:
    """``v`` times a gain that fades in from the shadows."""
    return v * (1 + smoothstep(v, low, high) * (k - 1))


def damp(background: DataFrame, k: DataFrame, low: float, high: float, hard: float = 1.08, budget: float = 0.01) -> DataFrame:
    """The strengths (alpha_r, alpha_b) of the gains k(frame_id, kr, kb) that keep the background's chroma scatter down.

    ``background`` (frame_id, r, g, b) holds sky pixels. The scatter of ln(colour / green) depends on one strength a
    colour, so it is taken 11 times for each colour in one pass, and only the few scores are crossed. Beyond ``hard``
    times the old scatter a strength is out; pairs that worsen by at most ``budget`` go before all others. (0, 0) remains.
    """
    df = background.join(k, "frame_id")
    ratio = lambda c: F.stddev_pop(F.ln(F.when(c > 0, c) / F.when(F.col("g") > 0, F.col("g"))))
    at = lambda n, a: F.round(ratio(attenuated(F.col(n), 1 + a * (F.col(f"k{n}") - 1), low, high)), 9)
    tried = lambda n: F.array(*(F.struct(F.lit(a).alias("alpha"), at(n, a).alias("now")) for a in STRENGTHS)).alias(n)
    scatter = df.groupBy("frame_id").agg(*(F.round(ratio(F.col(n)), 9).alias(f"was_{n}") for n in "rb"), tried("r"), tried("b"))
    pairs = scatter.select("frame_id", "was_r", "was_b", F.explode("r").alias("r"), "b").select("frame_id", "was_r", "was_b", "r", F.explode("b").alias("b"))
    change = lambda n: F.coalesce(F.when(F.col(f"was_{n}") > 0, F.col(f"{n}.now") / F.col(f"was_{n}") - 1), F.lit(0.0))
    pairs = pairs.select("frame_id", F.col("r.alpha").alias("alpha_r"), F.col("b.alpha").alias("alpha_b"), change("r").alias("dr"), change("b").alias("db")).where((F.col("dr") <= hard - 1) & (F.col("db") <= hard - 1))
    up = lambda s: F.greatest(s * F.col("dr"), F.lit(0.0)) + F.greatest(s * F.col("db"), F.lit(0.0))
    gain, uneven, moved = (F.col("alpha_r") + F.col("alpha_b")) / 2, F.abs(F.col("dr") - F.col("db")), F.abs("dr") + F.abs("db")
    inside = (F.col("dr") <= budget) & (F.col("db") <= budget)
    score = F.when(inside, gain + 0.6 * up(-1) - 0.8 * uneven - 0.2 * up(1)).otherwise(1.25 * gain - 4.5 * up(1) - 1.4 * uneven - 0.35 * moved + 0.7 * up(-1))
    best = F.max_by(F.struct("alpha_r", "alpha_b"), F.struct(inside, F.round(score, 6), "alpha_r", "alpha_b"))
    return pairs.groupBy("frame_id").agg(best.alias("a")).select("frame_id", "a.alpha_r", "a.alpha_b")
