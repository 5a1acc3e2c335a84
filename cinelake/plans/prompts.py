"""The two ends of a language model: request tables in, response tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinelake.functions.documents import fenced_json, fill_template, json_field, json_is_array, json_is_object, json_strings
from cinelake.functions.text import fill, fixed

# Heads of the requests, and the fields a response must have.
SCRIPT_HEAD = (
    "## Approved Narrative\n\n**Title**: {}\n**Description**: {}\n**Proposed duration**: {} seconds\n**Arc**: {}\n"
    "**Emotional journey**: {}\n\n## Full L-Storyboard\n\n"
)
EDL_HEAD = (
    "## Narrative\n\n**Title**: {}\n**Description**: {}\n**Target duration**: {} seconds\n\n"
    "## Script\n\n```json\n{}\n```\n\n## Storyboard\n\n"
)
REQUIRED = {
    "label": ("label", "description"),
    "narrative": ("title", "activity_cluster_ids", "proposed_duration_seconds"),
    "script": ("scenes",),
}


def label_requests(summaries: DataFrame, model: str) -> DataFrame:
    """One request per cluster: its summary as JSON."""
    fields = [c for c in ("time_range", "transcripts", "detections", "audio_events", "gps") if c in summaries.columns]
    return summaries.select(F.lit("label").alias("kind"), F.col("cluster_id").alias("target_id"), F.lit(model).alias("model"), F.to_json(F.struct(*fields)).alias("prompt"))


def system_prompt(template: str, creator: dict[str, str]):
    """A prompt template with the creator's profile filled in."""
    return fill_template(template, {k: F.lit(v) for k, v in creator.items()})


def narrative_requests(storyboards: DataFrame, model: str, template: str, creator: dict[str, str]) -> DataFrame:
    """One request per master storyboard page: the planner's template with the creator's profile, and the page.

    storyboards: target_id, page, storyboard.
    """
    return storyboards.select(
        F.lit("narrative").alias("kind"), "target_id", "page", F.lit(model).alias("model"), system_prompt(template, creator).alias("system"), F.col("storyboard").alias("prompt")
    )


def script_requests(narratives: DataFrame, storyboards: DataFrame, model: str) -> DataFrame:
    """One request per narrative and storyboard page: its description, then the storyboard.

    storyboards: narrative_id, page, storyboard. Page 0 carries the description.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = fill(SCRIPT_HEAD, *[text(c) for c in ("title", "description", "proposed_duration_seconds", "arc_notes", "emotional_journey")])
    return narratives.join(storyboards, "narrative_id").select(
        F.lit("script").alias("kind"), F.col("narrative_id").alias("target_id"), "page", F.lit(model).alias("model"),
        F.concat(F.when(F.col("page") == 0, head).otherwise(""), F.col("storyboard")).alias("prompt"),
    )


def edl_requests(narratives: DataFrame, scripts: DataFrame, storyboards: DataFrame, model: str) -> DataFrame:
    """As `script_requests`, with the script between description and storyboard."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = fill(EDL_HEAD, *[text(c) for c in ("title", "description", "proposed_duration_seconds", "script_json")])
    return narratives.join(scripts.select("narrative_id", "script_json"), "narrative_id").join(storyboards, "narrative_id").select(
        F.lit("edl").alias("kind"), F.col("narrative_id").alias("target_id"), "page", F.lit(model).alias("model"),
        F.concat(F.when(F.col("page") == 0, head).otherwise(""), F.col("storyboard")).alias("prompt"),
    )


def _checked(responses: DataFrame, required: tuple[str, ...], text: str, is_list: bool) -> DataFrame:
    body = responses.withColumn("body", fenced_json(F.col(text)))
    doc = F.try_parse_json("body")
    shape = json_is_array(F.col("body")) if is_list else json_is_object(F.col("body"))
    missing = F.lit(None)
    for name in reversed(required):
        missing = F.when(~F.coalesce(F.try_variant_get(doc, "$", "map<string,variant>").getItem(name).isNotNull(), F.lit(False)), F.lit(name)).otherwise(missing)
    error = F.when(doc.isNull(), "not JSON").when(~shape, "wrong shape")
    if not is_list:
        error = error.when(missing.isNotNull(), F.concat(F.lit("missing "), missing))
    return body.withColumn("error", error)


def parse_labels(responses: DataFrame, text: str = "response") -> tuple[DataFrame, DataFrame]:
    """(cluster labels, quarantine) from label responses (target_id, response)."""
    rows = _checked(responses, REQUIRED["label"], text, is_list=False)
    body = F.col("body")
    good = rows.filter("error is null").select(
        F.col("target_id").alias("cluster_id"), json_field(body, "$.label").alias("label"), json_field(body, "$.description").alias("description"),
        F.coalesce(json_field(body, "$.split_recommended", "boolean"), F.lit(False)).alias("split_recommended"), json_field(body, "$.split_reason").alias("split_reason"),
    )
    return good, rows.filter("error is not null").select("target_id", "error", text)


def parse_narratives(responses: DataFrame, text: str = "response") -> tuple[DataFrame, DataFrame]:
    """(proposed narratives with the `target_id` of their response, quarantine). One bad entry spoils its whole response, as nothing of it is stored."""
    rows = _checked(responses, (), text, is_list=True)
    items = F.try_variant_get(F.try_parse_json("body"), "$", "array<variant>")

    def wrong(e):
        fields = F.try_variant_get(e, "$", "map<string,variant>")
        missing = F.array_join(F.filter(F.array(*[F.lit(x) for x in sorted(REQUIRED["narrative"])]), lambda n: ~F.map_contains_key(fields, n)), ", ")
        return F.when(fields.isNull(), "entry is no object").when(missing != "", F.concat(F.lit("missing "), missing)).when(
            F.try_variant_get(e, "$.proposed_duration_seconds", "string").try_cast("double").isNull(), "proposed_duration_seconds is no number"
        )

    # A response is judged on its row: the first bad entry in it is its error.
    read = rows.withColumn("items", F.when(F.col("error").isNull(), items)).withColumn(
        "error", F.coalesce("error", F.get(F.filter(F.transform("items", wrong), lambda x: x.isNotNull()), F.lit(0)))
    )
    e = F.col("e")
    at = lambda path, t="string": F.try_variant_get(e, path, t)
    good = read.filter("error is null").select("target_id", F.posexplode("items").alias("pos", "e")).select(
        F.sha2(F.concat_ws(":", F.col("target_id").cast("string"), F.col("pos").cast("string")), 256).alias("narrative_id"),
        at("$.title").alias("title"), F.coalesce(at("$.reasoning"), F.lit("")).alias("description"),
        at("$.proposed_duration_seconds").try_cast("double").alias("proposed_duration_seconds"),
        at("$.activity_cluster_ids").alias("activity_cluster_ids_json"), F.coalesce(F.when(F.schema_of_variant(at("$.arc", "variant")).startswith("OBJECT"), at("$.arc")), F.lit("{}")).alias("arc_notes"),
        F.nullif(F.coalesce(at("$.emotional_journey"), F.lit("")), F.lit("")).alias("emotional_journey"), F.lit("proposed").alias("status"), "target_id",
    )
    return good, read.filter("error is not null").select("target_id", "error", text)


def parse_scripts(responses: DataFrame, text: str = "response") -> tuple[DataFrame, DataFrame]:
    """(scripts, quarantine) from script responses."""
    rows = _checked(responses, REQUIRED["script"], text, is_list=False)
    good = rows.filter("error is null").select(F.col("target_id").alias("narrative_id"), F.col("body").alias("script_json"))
    return good, rows.filter("error is not null").select("target_id", "error", text)


def review_text(narratives: DataFrame) -> DataFrame:
    """(narrative_id, number, text): proposals as shown to a reviewer, numbered in table order given by `pos`."""
    ids = F.array_join(json_strings(F.col("activity_cluster_ids_json")), ", ")
    arc = lambda phase, title: F.concat(F.lit(f"    {title}: "), json_field(F.col("arc_notes"), f"$.{phase}"))
    phases = F.concat_ws("\n", arc("beginning", "Beginning"), arc("middle", "Middle"), arc("end", "End"))
    minutes = F.col("proposed_duration_seconds") / F.lit(60.0)
    lines = F.concat_ws(
        "\n",
        fill("--- Narrative {} ---", F.col("number")), F.concat(F.lit("  Title: "), "title"),
        fill("  Duration: {}s ({} min)", fixed(F.col("proposed_duration_seconds"), 0), fixed(minutes, 1)),
        F.concat(F.lit("  Clusters: "), F.when(ids == "", "none").otherwise(ids)),
        F.when(phases != "", F.concat(F.lit("  Arc:\n"), phases)),
        F.when(F.coalesce("emotional_journey", F.lit("")) != "", F.concat(F.lit("  Emotional journey: "), "emotional_journey")),
        F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit("  Reasoning: "), "description")),
    )
    return narratives.select("narrative_id", "number", lines.alias("text"))
