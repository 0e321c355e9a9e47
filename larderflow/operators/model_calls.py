"""Requests to language models and what comes back, as columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import assemble, joined, let, metadata_yaml

PROMPT = """You turn recipes into plain-text markup.
Write the steps in {{LANGUAGE}}, one paragraph for each. Inside the steps mark what is used:
- an ingredient as @name{amount%unit}, with empty braces if no amount is given;
- a tool as #name{};
- a duration as ~{number%unit}.
Leave out lists of ingredients, titles, notes and greetings, change no amounts, and stay with {{LANGUAGE}} throughout.

The recipe:
{{RECIPE}}
"""
EXTRACT_PROMPT = """Find the recipe in the text that follows. Answer with one JSON object and nothing else; its keys are title, servings, prep_time, cook_time, total_time (strings, or null where the text doesn't say),
ingredients and instructions (lists of strings), and error (null, or why there is no recipe)."""

#: Frequent words by language; a text's language is the one whose words it has most of.
STOP_WORDS = {
    "English": "the and of to in is that it for with on as this are be from or an at you then until into",
    "German": "der die das und ist nicht ein eine mit den dem zu auf von für im sich auch es werden oder bis",
    "French": "le la les et est une des du que dans pour sur avec pas au qui par ce vous en plus jusqu",
    "Spanish": "el la los las y es una del que en por con para no se su al como más lo hasta entre",
    "Italian": "il lo gli e è una del che in per con non si su al come più nel della di fino",
    "Dutch": "de het een en is van op te dat in voor met niet zijn aan er ook als bij tot",
    "Portuguese": "o a os as e é uma do da que em por com para não se ao como mais até",
}
UNKNOWN_LANGUAGE = "the original language"


def detect_language(text: Column) -> Column:
    """English name of the text's language by its frequent words; a fixed phrase if it has none. Ties go to the order of STOP_WORDS."""
    every = {w for s in STOP_WORDS.values() for w in s.split()}

    def score(words: Column, k: int, lang: str) -> Column:
        return F.struct(F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS[lang].split()))).alias("n"), F.lit(-k).alias("o"), F.lit(lang).alias("l"))

    def best(words: Column) -> Column:
        scores = [score(words, k, lang) for k, lang in enumerate(STOP_WORDS)]
        return let(F.greatest(*scores), lambda b: F.when(b["n"] > 0, b["l"]).otherwise(UNKNOWN_LANGUAGE))

    # split once, and only frequent words are looked at again
    return let(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(*every)), best)


def prompt(text: Column, language: Column | None = None, template: str = PROMPT) -> Column:
    """The template with the recipe, then the language put in (also where the recipe itself has the language's mark)."""
    lang = detect_language(text) if language is None else language
    return F.replace(F.replace(F.lit(template), F.lit("{{RECIPE}}"), text), F.lit("{{LANGUAGE}}"), lang)


@dataclass
class Provider:
    """How to reach one provider. Keys never become columns; the transport reads them."""

    name: str
    model: str
    temperature: float = 0.7
    max_tokens: int = 4000
    options: dict[str, str] = field(default_factory=dict)

    def url(self) -> str:
        raise NotImplementedError

    def headers(self, key: str | None) -> dict[str, str]:
        return {"Authorization": f"Bearer {key}"} if key else {}

    def request(self, message: Column) -> Column:
        msg = F.struct(F.lit("user").alias("role"), message.alias("content"))
        return F.to_json(F.struct(F.lit(self.model).alias("model"), F.array(msg).alias("messages"), F.lit(self.temperature).alias("temperature"), F.lit(self.max_tokens).alias("max_tokens"), F.lit(False).alias("stream")))

    paths = ("$.choices[0].message.content", "$.model", "$.usage.prompt_tokens", "$.usage.completion_tokens")

    def failure(self, body: Column) -> Column:
        """What the body says of an error, or null."""
        at = lambda p: F.get_json_object(body, p)
        return F.when(at("$.error").isNotNull(), F.coalesce(at("$.error.message"), at("$.error")))

    def response(self, body: Column, latency: Column) -> Column:
        """struct(content, conversion, error) of a response body."""
        content, model, used, made = (F.get_json_object(body, p) for p in self.paths)
        message = F.coalesce(self.failure(body), F.when(content.isNull(), F.concat(F.lit("no content in the response: "), F.substring(F.coalesce(body, F.lit("")), 1, 500))))
        good = message.isNull()
        usage = F.when(used.isNotNull() & made.isNotNull(), F.struct(used.cast("bigint").alias("input_tokens"), made.cast("bigint").alias("output_tokens")))
        conversion = F.struct(F.coalesce(model, F.lit(self.model)).alias("model_version"), usage.alias("tokens_used"), latency.cast("bigint").alias("latency_ms"))
        return F.struct(F.when(good, content).alias("content"), F.when(good, conversion).alias("conversion"), F.when(~good, F.struct(F.lit("conversion").alias("kind"), message.alias("message"))).alias("error"))


class OpenAi(Provider):
    def url(self) -> str:
        return f"{self.options.get('base_url', 'https://api.openai.com')}/v1/chat/completions"


class AzureOpenAi(Provider):
    def url(self) -> str:
        o = self.options
        if not o.get("endpoint") or not o.get("deployment_name"):
            raise ValueError("azure_openai needs endpoint and deployment_name")
        return f"{o['endpoint'].rstrip('/')}/openai/deployments/{o['deployment_name']}/chat/completions?api-version={o.get('api_version', '2024-02-15-preview')}"

    def headers(self, key: str | None) -> dict[str, str]:
        return {"api-key": key or ""}


class Local(Provider):
    def url(self) -> str:
        return f"{self.options.get('base_url', 'http://localhost:11434')}/v1/chat/completions"

    def headers(self, key: str | None) -> dict[str, str]:
        return {}


class Anthropic(Provider):
    paths = ("$.content[0].text", "$.model", "$.usage.input_tokens", "$.usage.output_tokens")

    def url(self) -> str:
        return "https://api.anthropic.com/v1/messages"

    def headers(self, key: str | None) -> dict[str, str]:
        return {"x-api-key": key or "", "anthropic-version": "2023-06-01"}

    def request(self, message: Column) -> Column:
        msg = F.struct(F.lit("user").alias("role"), message.alias("content"))
        return F.to_json(F.struct(F.lit(self.model).alias("model"), F.lit(self.max_tokens).alias("max_tokens"), F.lit(self.temperature).alias("temperature"), F.array(msg).alias("messages")))

    def failure(self, body: Column) -> Column:
        at = lambda p, d: F.coalesce(F.get_json_object(body, p), F.lit(d))
        return F.when(F.get_json_object(body, "$.error").isNotNull(), F.concat(at("$.error.type", "unknown"), F.lit(": "), at("$.error.message", "unknown error")))


class Google(Provider):
    paths = ("$.candidates[0].content.parts[0].text", "$.modelVersion", "$.usageMetadata.promptTokenCount", "$.usageMetadata.candidatesTokenCount")

    def url(self) -> str:
        host = self.options.get("base_url", "https://generativelanguage.googleapis.com")
        return f"{host}/v1beta/models/{self.model}:generateContent"

    def headers(self, key: str | None) -> dict[str, str]:
        return {"x-goog-api-key": key or ""}

    def request(self, message: Column) -> Column:
        parts = F.array(F.struct(F.array(F.struct(message.alias("text"))).alias("parts")))
        how = F.struct(F.lit(self.temperature).alias("temperature"), F.lit(self.max_tokens).alias("maxOutputTokens"))
        return F.to_json(F.struct(parts.alias("contents"), how.alias("generationConfig")))

    def failure(self, body: Column) -> Column:
        at = lambda p, d: F.coalesce(F.get_json_object(body, p), F.lit(d))
        return F.when(F.get_json_object(body, "$.error").isNotNull(), F.concat(at("$.error.code", "0"), F.lit(": "), at("$.error.message", "unknown error")))


PROVIDERS = {"open_ai": OpenAi, "anthropic": Anthropic, "azure_openai": AzureOpenAi, "google": Google, "ollama": Local}
DEFAULT_MODELS = {"open_ai": "gpt-4.1-mini", "anthropic": "claude-3-5-sonnet-20241022", "azure_openai": "gpt-4", "google": "gemini-1.5-flash", "ollama": "llama3"}
KEY_VARIABLES = {"open_ai": ["OPENAI_API_KEY"], "anthropic": ["ANTHROPIC_API_KEY"], "azure_openai": ["AZURE_OPENAI_API_KEY", "AZURE_OPENAI_ENDPOINT"], "google": ["GOOGLE_API_KEY"], "ollama": []}


def provider(name: str, **how) -> Provider | None:
    """A provider by name; None for an unknown name or settings that it can't work with."""
    kind = PROVIDERS.get(name)
    if kind is None:
        return None
    p = kind(name, how.pop("model", None) or DEFAULT_MODELS[name], **how)
    try:
        p.url()
    except ValueError:
        return None
    return p


def available(name: str, env: dict[str, str]) -> bool:
    """Whether the environment has what the provider needs."""
    return name in KEY_VARIABLES and all(env.get(v) for v in KEY_VARIABLES[name])


def extraction_request(text: Column, model: str = "gpt-4o-mini") -> Column:
    """Request that has a model read a recipe out of a text as strict JSON."""
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    form = F.struct(F.lit("json_object").alias("type"))
    return F.to_json(F.struct(F.lit(model).alias("model"), form.alias("response_format"), F.array(msg("system", F.lit(EXTRACT_PROMPT)), msg("user", text)).alias("messages")))


def extraction_components(payload: Column, source: Column) -> Column:
    """struct(components, error) of the JSON that the model gave."""
    return let(F.try_parse_json(payload), lambda v: _extracted(v, source))


def _extracted(v: Column, source: Column) -> Column:
    string = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    text = lambda k: string(F.try_variant_get(v, f"$.{k}", "variant"))

    def items(k: str, by: str) -> Column:
        # what isn't a string is null, which joining leaves out
        return F.coalesce(F.array_join(F.transform(F.try_variant_get(v, f"$.{k}", "array<variant>"), string), by), F.lit(""))

    entry = lambda k, x: F.struct(F.lit(k).alias("k"), x.alias("v"))
    meta = F.filter(F.array(entry("source", source), *[entry(k, text(k)) for k in ("servings", "prep_time", "cook_time", "total_time")]), lambda e: (F.coalesce(e["v"], F.lit("")) != "") | (e["k"] == "source"))
    body = F.concat(items("ingredients", "\n"), F.lit("\n\n"), items("instructions", " "))
    parts = F.struct(body.alias("text"), metadata_yaml(meta).alias("metadata"), F.coalesce(text("title"), F.lit("")).alias("name"))

    def both(error: Column) -> Column:
        error = F.when(error != "", error)
        return F.struct(F.when(error.isNull(), parts).alias("components"), F.when(error.isNotNull(), F.struct(F.lit("extraction").alias("kind"), error.alias("message"))).alias("error"))

    return let(F.coalesce(F.when(v.isNull(), F.lit("the answer isn't JSON")).otherwise(text("error")), F.lit("")), both)


def to_markup(df: DataFrame, calls, providers: list[Provider]) -> DataFrame:
    """Adds `content`, `conversion` and `error` for a DataFrame with `components`: the text goes to the first provider, and on failure to the next ones; name
    and metadata are put around what comes back. `calls` is a transport (see sources.transport)."""
    out = df.withColumn("_m", prompt(F.col("components.text")))
    for k, p in enumerate(providers):
        asked = F.when(F.col("components").isNotNull() & (F.lit(k == 0) | F.col("_got.content").isNull() if k else F.lit(True)), p.request(F.col("_m")))
        out = calls.post(out.withColumn("_q", asked), p.url(), p.headers, p.name, "_q", "_r")
        got = p.response(F.col("_r.body"), F.col("_r.latency_ms"))
        got = F.when(F.col("_r.error").isNotNull(), F.struct(F.lit(None).cast("string").alias("content"), F.lit(None).cast(got_type(p)).alias("conversion"), F.struct(F.lit("fetch").alias("kind"), F.col("_r.error").alias("message")).alias("error"))).otherwise(got)
        got = F.when(F.col("_q").isNotNull(), got)
        out = out.withColumn("_got", F.coalesce(got, F.col("_got")) if k else got).drop("_q", "_r")
    c = F.col("components")
    return out.withColumns({"content": F.when(F.col("_got.content").isNotNull(), assemble(F.col("_got.content"), c["name"], c["metadata"])), "conversion": F.col("_got.conversion"), "error": F.col("_got.error")}).drop("_m", "_got")


def got_type(_: Provider) -> str:
    return "struct<model_version:string,tokens_used:struct<input_tokens:bigint,output_tokens:bigint>,latency_ms:bigint>"
