"""Prompt templates: parsing, substitution, rendering and the cross product with papers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PLACEHOLDER = "<paper text inserted here>"


def parse_template(text: str) -> dict[str, list[str]]:
    """Bodies under the headings ``System Prompt`` and ``User Prompt``; ``--- n ---`` begins another one, fences are dropped."""
    out: dict[str, list[str]] = {"system": [], "user": []}
    section, body, numbered = None, [], re.compile(r"^-{3,}\s*\d+\s*-{3,}$")

    def close():
        t = "\n".join(body).strip()
        if section and t:
            out[section].append(t)
        body.clear()

    for line in text.splitlines():
        plain = line.strip().strip("#*: ").lower()
        if plain in ("system prompt", "system prompts", "user prompt", "user prompts"):
            close()
            section = plain.split()[0]
        elif numbered.match(line.strip()):
            close()
        elif not line.strip().startswith("```"):
            body.append(line)
    close()
    return out


def substitute(text: str, files: dict[str, str], steps: dict[int, str] | None = None) -> str:
    """``<name>`` by the named text, ``<step N formatting instructions>`` by the N-th; unknown names stay."""
    text = re.sub(r"<step (\d+) formatting instructions>", lambda m: (steps or {}).get(int(m[1]), m[0]), text)
    for name, body in files.items():
        text = text.replace(f"<{name}>", body)
    return text


def read_referenced(name: str, files: dict[str, str]) -> str:
    return files.get(name, f"<File not found: {name}>")


def render_format(template: str, values: dict[str, str]) -> str:
    """``str.format`` rendering; a missing key raises KeyError."""
    return template.format(**values)


def variations(prompts: dict[str, list[str]], shot: str, zero_shot: list[str]) -> list[dict]:
    """Prompt configurations of a shot type: other types are crossed with the zero-shot systems."""
    systems = [(f"{i + 1}", s) for i, s in enumerate(prompts["system"])]
    if shot != "zero-shot":
        systems = [(f"{i}_zs{j + 1}", f"{z}\n\n{s}") for i, s in (systems or [("1", "")]) for j, z in enumerate(zero_shot or [""])]
    return [{"shot_type": shot, "variation": v, "user_file": f"{u + 1}", "system": s, "user": t} for v, s in systems for u, t in enumerate(prompts["user"])]


def prompt_table(spark: SparkSession, configurations: list[dict]) -> DataFrame:
    return spark.createDataFrame([(c["shot_type"], c["variation"], c["user_file"], c["system"], c["user"]) for c in configurations], "shot_type string, variation string, user_file string, system string, user string").orderBy("variation", "user_file")


PROMPT = "shot_type string, variation string, system_file string, user_file string, system string, user string, steps array<struct<step:int,system:string,user:string>>"


def _prompt_files(spark: SparkSession, folder: str) -> tuple[str, list[tuple[str, str]], list[tuple[str, str]]]:
    """The folder's name and its (file, text) of system and of user prompts, by name: a few small files."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.option("pathGlobFilter", "{system,user}_prompt*.txt").text(folder, wholetext=True).select(F.substring_index("_metadata.file_path", "/", -1).alias("name"), "value").collect()
    except AnalysisException as missing:
        raise FileNotFoundError(folder) from missing
    found = sorted((r["name"], r["value"]) for r in rows)
    system, user = ([x for x in found if x[0].startswith(p)] for p in ("system_prompt", "user_prompt"))
    return folder.rstrip("/").split("/")[-1], system, user


def load_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt configurations of a shot type's folder: each system prompt with each user prompt, or the user prompts alone
    (variation 'default'), by variation and user file.  ValueError without a user prompt."""
    shot, systems, users = _prompt_files(spark, folder)
    if not users:
        raise ValueError(f"no user prompt in {folder}")
    pairs = [(n[:-4].replace("system_prompt_", "zs"), n, t) for n, t in systems] or [("default", None, None)]
    rows = [(shot, variation, name, user, system, text, None) for variation, name, system in pairs for user, text in users]
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[3])), PROMPT)


def load_stepwise(spark: SparkSession, folder: str) -> DataFrame:
    """One configuration of a folder of stepwise prompts, by its name: ``all_in_one`` (the first system prompt with
    ``user_prompt`` or ``..._1``), ``system_stepwise`` (the n-th system with the n-th user prompt) or ``user_stepwise``
    (one system prompt, a user prompt a step).  ValueError if files are missing or the name is another."""
    name, systems, users = _prompt_files(spark, folder)
    kind = next((k for k in ("all_in_one", "system_stepwise", "user_stepwise") if k in name.lower()), None)
    if kind is None:
        raise ValueError(f"{folder} is no folder of stepwise prompts")
    if kind == "all_in_one":
        users = [u for u in users if u[0][:-4] == "user_prompt" or u[0][:-4].endswith("_1")]
    if not systems or not users:
        raise ValueError(f"prompts are missing in {folder}")
    if kind == "all_in_one":
        row = (name, "default", systems[0][0], users[0][0], systems[0][1], users[0][1], None)
    else:
        pairs = zip(systems, users) if kind == "system_stepwise" else ((systems[0], u) for u in users)
        steps = [(i, s[1], u[1]) for i, (s, u) in enumerate(pairs, 1)]
        row = (name, "default", None if kind == "system_stepwise" else systems[0][0], None, None, None, steps)
    return spark.createDataFrame([row], PROMPT)


def template_set(templates: dict[str, str], files: dict[str, str], steps: dict[int, str] | None = None, zero_shot: list[str] | None = None) -> list[dict]:
    """Prompt configurations of a set of templates (name: text): parsed, references substituted, expanded to variations.
    A template that is empty or has no prompt is left out; stepwise sets are expanded without zero-shot systems."""
    out = []
    for name, text in templates.items():
        parsed = {k: [substitute(t, files, steps) for t in found] for k, found in parse_template(text or "").items()}
        if any(parsed.values()):
            plain = zero_shot is None
            out += [{**v, "shot_type": name} for v in variations(parsed, "zero-shot" if plain else name, zero_shot or [])]
    return out


def render(template, text) -> Column:
    return F.replace(template, F.lit(PLACEHOLDER), text)


def prompt_papers(prompts: DataFrame, papers: DataFrame, text: str = "text") -> DataFrame:
    """Every prompt with every paper that has a text, rendered.  The prompts, a few files, are held as one array and exploded."""
    names = [c for c in prompts.columns if c != "user"]
    listed = prompts.agg(F.collect_list(F.struct(*prompts.columns)).alias("p")).first()[0]
    array = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in prompts.columns)) for r in listed))
    rows = papers.where(F.col(text).isNotNull()).withColumn("_p", F.explode(array))
    return rows.select(*(c for c in papers.columns if c != text), *(F.col(f"_p.{c}").alias(c) for c in names), render(F.col("_p.user"), F.col(text)).alias("user"))


def compose(user, contexts) -> Column:
    """An optional ``Context:`` block, then the user's text."""
    block = F.when(F.size(contexts) > 0, F.concat(F.lit("Context:\n"), F.array_join(contexts, "\n\n")))
    return F.concat_ws("\n\n", block, user)


def default_prompt(text, contexts=None, task: str = "Extract the argument map.", reason: bool = False, keys: str = "ACC, ARI, ARC") -> Column:
    parts = [] if contexts is None else [F.when(F.size(contexts) > 0, F.concat(F.lit("Context:\n"), F.array_join(contexts, "\n")))]
    parts += [F.lit(f"Task: {task}"), *([F.lit("Think step by step.")] if reason else []), F.concat(F.lit("Input:\n"), text), F.lit(f"Return JSON with keys: {keys}")]
    return F.concat_ws("\n\n", *parts)


def step_instruction(i: int, system, user, prompt) -> Column:
    """The step's own system and user texts, else ``Step i: prompt``."""
    own = F.concat_ws("\n\n", F.when(F.trim(system) != "", system), F.when(F.trim(user) != "", user))
    return F.when(own != "", own).otherwise(F.concat(F.lit(f"Step {i}: "), prompt))


def fold_turns(turns: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, transcript): the texts of a conversation in order."""
    return turns.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit("")).alias("t")))), lambda x: x.t), "\n\n").alias("transcript"))


def hyper_parameters(spark: SparkSession, n: int, temperature=(0.0, 1.0), tokens=(256, 4096), seed: int = 42) -> DataFrame:
    draw = spark.range(n).select("id", F.rand(seed).alias("a"), F.rand(seed + 1).alias("b"))
    return draw.select("id", (temperature[0] + F.col("a") * (temperature[1] - temperature[0])).alias("temperature"), F.floor(tokens[0] + F.col("b") * (tokens[1] - tokens[0] + 1)).cast("int").alias("max_tokens"))
