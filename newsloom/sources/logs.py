"""Evaluation logs: negatives, recommendations, id lists, metrics."""

from pyspark.sql import functions as F

from newsloom.functions.text import join_ids
from newsloom.operators.metrics import metrics_table
from newsloom.schema import CLICK, KEY


def negatives_log(negatives):
    """One row per session: negatives of each click, in click order."""
    per_click = negatives.groupBy(*CLICK).agg(
        F.sort_array(F.collect_list(F.struct("neg_pos", "item_id"))).alias("_n"))
    per_click = per_click.withColumn("_n", F.transform("_n", lambda x: x["item_id"]))
    return (per_click.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "_n"))).alias("_c"))
            .select("user_id", F.col("session_id").cast("string").alias("session_id"),
                    F.transform("_c", lambda x: x["_n"]).alias("negative_items")))


def recommendations_log(preds, labels, digits=7):
    """One row per session: labels, predicted ids, probabilities and popularity per click."""
    per_click = preds.groupBy("state_step", *CLICK).agg(F.sort_array(F.collect_list(F.struct(
        "rank", "item_id", F.round("prob", digits).alias("prob"),
        F.round("norm_pop", digits).alias("norm_pop")))).alias("_p"))
    rows = labels.select(*CLICK, "label").join(per_click, CLICK)
    packed = rows.groupBy("state_step", *KEY).agg(
        F.sort_array(F.collect_list(F.struct("pos", "label", "_p"))).alias("_c"))

    def each(field):
        return F.transform("_c", lambda c: F.transform(c["_p"], lambda p: p[field]))
    return packed.select(
        F.col("state_step").alias("eval_hour_id"), "user_id",
        F.col("session_id").cast("string").alias("session_id"),
        F.transform("_c", lambda c: c["label"]).alias("next_click_labels"),
        each("item_id").alias("predicted_item_ids"), each("prob").alias("predicted_item_probs"),
        each("norm_pop").alias("predicted_item_norm_pop"))


def prediction_strings(preds):
    """Per session: ids of a click by ',', clicks by '|'."""
    per_click = preds.groupBy(*CLICK).agg(
        F.sort_array(F.collect_list(F.struct("rank", "item_id"))).alias("_l"))
    text = join_ids(F.transform("_l", lambda x: x["item_id"]))
    return (per_click.select(*CLICK, text.alias("_t")).groupBy(*KEY)
            .agg(F.sort_array(F.collect_list(F.struct("pos", "_t"))).alias("_c"))
            .select(*KEY, F.array_join(F.transform("_c", lambda x: x["_t"]), "|").alias("predictions")))


def write_eval_logs(recs, negs, path, mode="error"):
    recs.write.mode(mode).json(f"{path}/recommendations")
    negs.write.mode(mode).json(f"{path}/negatives")


def write_metrics(metrics, path, k, mode="error"):
    """Metric log as CSV with hour and day of each evaluation step."""
    metrics_table(metrics, k).write.mode(mode).option("header", True).csv(path)
