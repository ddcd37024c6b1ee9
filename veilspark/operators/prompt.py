"""Row serialisers, prompt assembly, and lenient parsing of scorer replies."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, format_value, yes_no
from ..sources.schema import PublicSchema

#: Introductions and questions of known datasets (fixed values).
SENTENCES = {
    "banking": ("A client contacted during a direct marketing campaign by a banking institution is described as follows: ", "Will this client subscribe to a term deposit?"),
    "magic": ("A particle event recorded by an atmospheric Cherenkov gamma telescope is described as follows: ", "Is this event a gamma signal?"),
    "phishing": ("A website is described using URL and webpage attributes as follows: ", "Is this website a phishing website?"),
    "abalone": ("An abalone specimen is described as follows: ", "Is this abalone in the positive age class?"),
    "shoppers": ("An online shopping session is described as follows: ", "Does this session lead to a purchase?"),
    "defaultcredit": ("A credit card client is described using demographic, payment, bill, and repayment attributes as follows: ", "Will this client default on payment?"),
    "airline": ("An airline passenger is described as follows: ", "Is this passenger satisfied with their overall flight experience?"),
    "weather": ("The weather observations at a specific monitoring station are described as follows: ", "Will it rain tomorrow?"),
}
#: Sentence frames with a place per column (fixed values).
FRAMES = {
    "adult": (
        "An individual recorded in the 1994 US census is described as follows: This person is {age} years old. Their workclass is {workclass}. Their education is {education}. "
        "Their marital status is {marital-status}. Their occupation is {occupation}. Their relationship status is {relationship}. Their race is {race}. Their sex is {sex}. "
        "Their capital gain is {capital-gain}. Their capital loss is {capital-loss}. They work {hours-per-week} hours per week. Their native country is {native-country}. ",
        "Does this person earn more than 50,000 dollars annually?",
    ),
    "diabetes": (
        "The following describes diagnostic measurements for a patient. The patient has been pregnant {Pregnancies} times. The plasma glucose concentration is {Glucose}. "
        "The blood pressure is {BloodPressure}. The skin thickness is {SkinThickness}. The insulin value is {Insulin}. The body mass index is {BMI}. "
        "The diabetes pedigree function is {DiabetesPedigreeFunction}. The age is {Age}. ",
        "Does this patient have diabetes?",
    ),
}
#: Introduction of the plain list (fixed value).
CENSUS_INTRO = "An individual recorded in the 1994 US census has the following attributes:"
MODES = ("json", "natural", "sentence")


def shown(df: DataFrame, schema: PublicSchema, name: str) -> Column:
    """A cell as a prompt shows it: numerics are taken as already in original units."""
    if name not in df.columns:
        return F.lit("NA")
    return format_value(col(name), name in schema.numeric and dict(df.dtypes)[name] in ("double", "float"))


def serialize_list(df: DataFrame, schema: PublicSchema, intro: str = CENSUS_INTRO) -> Column:
    """``intro; name is value; ....`` with dashes as spaces."""
    clean = lambda c: c.replace("-", " ").replace("_", " ")
    parts = [F.concat(F.lit(f"{clean(c)} is "), F.translate(shown(df, schema, c), "-", " ")) for c in schema.features]
    return F.concat(F.concat_ws("; ", F.lit(intro), *parts), F.lit("."))


def serialize_json(df: DataFrame, schema: PublicSchema, label: bool = False) -> Column:
    """Compact JSON of strings in column order; names, values and units decoded if the schema says so."""
    names, values, units = schema.prompt_metadata()
    fields = []
    for c in schema.features:
        value, name = shown(df, schema, c), c
        if schema.decode_values:
            name = names.get(c, c)
            if values.get(c):
                table = F.create_map(*[x for k, v in values[c].items() for x in (F.lit(k), F.lit(v))])
                value = F.coalesce(F.try_element_at(table, value), value)
            if c in units:
                value = F.concat(value, F.lit(" " + units[c]))
        fields.append(value.alias(name))
    if label:
        fields.append(F.col("target").cast("int").cast("string").alias("label"))
    return F.to_json(F.struct(*fields))


def serialize_sentence(df: DataFrame, schema: PublicSchema, label: bool = False) -> Column:
    """A sentence about the row and the dataset's yes-or-no question."""
    ds = schema.name.lower()
    if ds in FRAMES:
        frame, question = FRAMES[ds]
        parts, rest = [], frame
        while "{" in rest:
            before, _, tail = rest.partition("{")
            name, _, rest = tail.partition("}")
            parts += [F.lit(before), shown(df, schema, name)]
        body = F.concat(*parts, F.lit(rest))
    else:
        intro, question = SENTENCES.get(ds, (f"An instance from the {schema.task} dataset is described as follows: ", "Is the correct label positive?"))
        listed = F.concat_ws("; ", *[F.concat(F.lit(c.replace("_", " ") + " is "), shown(df, schema, c)) for c in schema.features])
        body = F.concat(F.lit(intro), listed, F.lit(". "))
    asked = F.lit(question + " Yes or No? Answer:")
    return F.concat(body, asked, F.lit(" "), yes_no(F.col("target"))) if label else F.concat(body, asked)


def example(df: DataFrame, schema: PublicSchema, mode: str) -> Column:
    """A demonstration's text without its number."""
    if mode == "natural":
        return F.concat(serialize_list(df, schema), F.lit(" Label: "), F.col("target").cast("int").cast("string"))
    if mode == "json":
        return F.concat(F.lit("\nInput: "), serialize_json(df, schema), F.lit("\nLabel: "), F.col("target").cast("int").cast("string"), F.lit("\n"))
    if mode == "sentence":
        return F.concat(F.lit("\n"), serialize_sentence(df, schema, True), F.lit("\n"))
    raise ValueError(f"unknown serialisation {mode!r}; known: {MODES}")


def system_message(mode: str) -> str:
    # fixed values
    if mode == "sentence":
        return "Follow the labeled examples. Output exactly one answer: Yes or No."
    return "Follow the labeled examples. Output exactly one label: 0 or 1."


def header(schema: PublicSchema, mode: str) -> str:
    # fixed values
    if mode == "sentence":
        return f"Use the labeled examples to perform {schema.task}.\nAnswer the final question with only Yes or No.\n"
    return f"Use the labeled examples to perform {schema.task} for the query instance.\nAllowed labels: 0 or 1.\nReturn only 0 or 1.\n"


def query_text(df: DataFrame, schema: PublicSchema, mode: str) -> Column:
    if mode == "natural":
        return F.concat(F.lit("Query: "), serialize_list(df, schema), F.lit(" Label:"))
    if mode == "json":
        return F.concat(F.lit("Query:\nInput: "), serialize_json(df, schema), F.lit("\nLabel:"))
    if mode == "sentence":
        return F.concat(F.lit("Query:\n"), serialize_sentence(df, schema))
    raise ValueError(f"unknown serialisation {mode!r}; known: {MODES}")


def unscaled(df: DataFrame, schema: PublicSchema, digits: int = 2) -> DataFrame:
    """Numerics back in original units; other columns as they are."""
    from ..functions.exprs import unscale

    return df.withColumns({c: unscale(schema, c, digits) for c in schema.numeric if c in df.columns})


def prompts(queries: DataFrame, demos: DataFrame, schema: PublicSchema, mode: str = "json", query_key: str = "query_id") -> DataFrame:
    """(query key, system_message, user_message): one aggregate over the demonstrations, a bounded few per query."""
    shown_q, shown_d = unscaled(queries, schema), unscaled(demos, schema)
    texts = shown_d.select(query_key, F.struct("demo_rank", example(shown_d, schema, mode).alias("text")).alias("d"))
    gathered = texts.groupBy(query_key).agg(F.sort_array(F.collect_list("d")).alias("ds"))
    numbered = F.transform(F.col("ds"), lambda d: F.concat(F.lit("Example "), d["demo_rank"].cast("string"), F.lit(": " if mode == "natural" else ":"), d["text"]))
    asked = shown_q.select(query_key, query_text(shown_q, schema, mode).alias("q")).join(gathered, query_key, "left")
    none = F.array().cast("array<string>")
    user = F.concat_ws("\n", F.lit(header(schema, mode)), F.array_join(F.coalesce(numbered, none), "\n"), F.col("q"))
    user = F.when(F.size(F.coalesce(numbered, none)) == 0, F.concat_ws("\n", F.lit(header(schema, mode)), F.col("q"))).otherwise(user)
    return asked.select(query_key, F.lit(system_message(mode)).alias("system_message"), user.alias("user_message"))


def scorer_input(system: Column, user: Column, mode: str = "json") -> Column:
    """Both messages as one text that ends where the answer begins."""
    cue = "Answer:" if mode == "sentence" else "Label:"
    text = F.concat(F.trim(system), F.lit("\n\n"), F.rtrim(user))
    return F.concat(F.when(F.endswith(text, F.lit(cue)), text).otherwise(F.concat(text, F.lit("\n" + cue))), F.lit(" "))


def left_truncated(text: Column, max_tokens: int) -> Column:
    """The last ``max_tokens`` tokens of a text, a token being a word with the white space before it; the answer's cue stays."""
    tokens = F.regexp_extract_all(text, F.lit(r"(\s*\S+|\s+$)"))
    return F.when(F.size(tokens) <= max_tokens, text).otherwise(F.regexp_replace(F.array_join(F.slice(tokens, -max_tokens, max_tokens), ""), r"^\s+", ""))


# -- weighting prompt and replies -----------------------------------------------------------------


def target_description(schema: PublicSchema) -> str:
    names = {"label", schema.label}
    for c in schema.columns:
        if c.get("name") in names and c.get("type") == "categorical" and c.get("i2s"):
            return f"{schema.task}; target classes are {[str(v) for v in c['i2s']]}"
    return schema.task


def feature_description(schema: PublicSchema, feature: str) -> str:
    meta = next((c for c in schema.columns if str(c.get("name")) == feature), {})
    kind = "continuous" if feature in schema.numeric else "categorical" if feature in schema.categorical else "unknown"
    lines = [f"Feature name: {feature}", f"Type: {kind}"]
    if "description" in meta:
        lines.append(f"Description: {meta['description']}")
    if "min" in meta and "max" in meta:
        lines.append(f"Real-World Range: [{meta['min']} to {meta['max']}] {meta.get('unit', '')}".strip())
    if "value_labels" in meta:
        lines.append(f"Value Meanings: {json.dumps(meta['value_labels'])}")
    return "\n".join(lines)


def summary_line(schema: PublicSchema) -> Column:
    """One line per class prototype, numerics in original units with two decimals."""
    parts = []
    for c in schema.features:
        if c in schema.numeric:
            low, high = schema.bound(c)
            parts.append(F.concat(F.lit(f"{c}="), F.format_string("%.2f", col(c) * (high - low) + low)))
        else:
            parts.append(F.concat(F.lit(f"{c}="), format_value(col(c), False)))
    return F.concat(F.lit("Class summary (label="), F.col("target").cast("string"), F.lit("): "), F.concat_ws(", ", *parts))


def weighting_prompt(schema: PublicSchema, lines: Sequence[str]) -> str:
    # fixed wording
    described = "\n\n".join(feature_description(schema, f) for f in schema.features)
    return (
        f"Prediction Task: {target_description(schema)}\n\nClass-Conditioned Privacy-Preserving Summaries:\n" + "\n".join(lines)
        + f"\n\nFeature Metadata:\n{described}\n\nReturn ONLY a valid JSON dictionary mapping every feature to a score in [0.05, 1.00]."
    )


def extract_object(text: Column) -> Column:
    """The JSON object in a reply as map<string, string>, or null.

    Trailing commas go, a key's missing opening quote is put in, and text around the
    outermost braces is ignored if the whole is not an object.
    """
    fixed = F.regexp_replace(F.trim(text.cast("string")), r",\s*\}", "}")
    fixed = F.regexp_replace(fixed, r"([\{,]\s*)/?([a-zA-Z0-9_ -]+)\":", '$1"$2":')
    kind = "map<string,string>"
    inner = F.regexp_extract(fixed, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.from_json(fixed, kind), F.from_json(F.when(inner != "", inner), kind))


def parse_weights(text: Column, features: Sequence[str]) -> Column:
    """map feature -> weight in [0, 1]; what is missing or no number counts 0.5."""
    found = extract_object(text)

    def one(f: str) -> Column:
        v = F.try_element_at(found, F.lit(f)).try_cast("double")
        return F.when(v.isNull() | F.isnan(v), F.lit(0.5)).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))

    return F.create_map(*[x for f in features for x in (F.lit(f), one(f))])


def normalize_weights(raw: Column, features: Sequence[str]) -> Column:
    """Weights over their mean; all ones if the mean is not positive."""
    mean = sum((raw[f] for f in features), F.lit(0.0)) / float(len(features))
    return F.create_map(*[x for f in features for x in (F.lit(f), F.when(mean > 0, raw[f] / mean).otherwise(F.lit(1.0)))])
