"""Question answering over retrieval results."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphfold.config import EngineConfig
from graphfold.errors import Upstream
from graphfold.functions.text import informative, strip
from graphfold.operators import retrieval as R
from graphfold.operators.graph import settle
from graphfold.plans.written import materialize
from graphfold.sources.clients import LanguageClient, with_completions, with_retries

ANSWER_SYSTEM = "Answer the question from the context alone, and name what you rely on. Say so if the context does not answer it."
MAP_SYSTEM = "Answer the question from this community's summary alone. If it says nothing about it, answer NO_INFO."
REDUCE_SYSTEM = "Combine the partial answers into one answer to the question. Do not add facts."
NO_CONTEXT = "Nothing in the graph bears on this question."
NO_GENERATION = "The sources below were found, but no answer could be written."
ALL_FAILED = "every community map gave NO_INFO or failed"


@dataclass
class Answer:
    answer: str
    sources: list
    mode: str
    confidence: float | None
    error: str | None = None
    subgraph: tuple[DataFrame, DataFrame] | None = None


def map_partials(hits: DataFrame, question: str, client: LanguageClient, config: EngineConfig) -> DataFrame:
    """hits with a reply or an error for each: one request a hit, a bounded number at a time."""
    prompt = F.concat(F.lit("Community: "), "node_name", F.lit("\nSummary:\n"), "text", F.lit(f"\n\nQuestion: {question}\n\nPartial answer:"))
    asked = with_completions(hits.withColumn("prompt", prompt), client, config, MAP_SYSTEM, temperature=0.1, concurrency=config.global_map_concurrency)
    return materialize(asked, "partials")  # read more than once, asked once


def reduce_prompt(mapped: DataFrame, question: str) -> DataFrame:
    """One row: the usable partials in the order of hits (null if none), and the first error."""
    usable = mapped.where(F.col("reply_error").isNull() & informative(F.col("reply")))
    order = F.struct((-F.col("score")).alias("s"), "id", F.concat(F.lit("["), "node_name", F.lit("]\n"), strip(F.col("reply"))).alias("block"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["block"]), "\n\n")
    one = usable.agg(F.when(F.count("*") > 0, F.concat(F.lit(f"Question: {question}\n\nPartial answers:\n"), text, F.lit("\n\nFinal answer:"))).alias("prompt"))
    first = mapped.where(F.col("reply_error").isNotNull()).agg(F.min_by("reply_error", F.struct((-F.col("score")).alias("s"), "id")).alias("error"))
    return one.join(F.broadcast(first), how="cross")  # one row each


def ask(g: R.Graph, question: str, vector: Sequence[float], client: LanguageClient, config: EngineConfig, mode: str = "auto", top_k: int | None = None, include_sources: bool = True, **filters) -> Answer:
    """Global questions are mapped over communities and reduced; others are answered from packed context.

    A failing model gives a partial answer with sources and the error; without hits no model is asked.
    """
    mode = R.resolve_mode(g, question, vector, config, mode)
    found = R.global_(g, vector, config, top_k) if mode == "global" else R.search(g, question, vector, config, mode, top_k, **filters)
    # the answer reads no more of ranked hits than its context can hold and its sources and confidence name; maps read all
    read = max(R.most_packed(config.context_token_budget), top_k or config.retrieval_top_k, config.retrieval_top_k)
    hits = settle(found.hits if found.mode == "global" else found.hits.limit(read))
    if not hits.limit(1).count():
        return Answer(NO_CONTEXT, [], found.mode, None)

    def result(answer: str, error: str | None = None) -> Answer:
        rows = R.sources(hits, top_k or config.retrieval_top_k).collect() if include_sources else []
        sure = R.confidence(hits, config.retrieval_top_k).collect()[0]["confidence"]
        return Answer(answer, rows, found.mode, sure, error, (found.nodes, found.edges) if include_sources else None)

    system, temperature = ANSWER_SYSTEM, 0.2
    if found.mode == "global":
        row = reduce_prompt(map_partials(hits, question, client, config), question).collect()[0]
        if row["prompt"] is None:
            return result(NO_GENERATION, row["error"] or ALL_FAILED)
        system, prompt = REDUCE_SYSTEM, row["prompt"]
    else:
        context = R.pack_context(hits, config.context_token_budget).collect()[0]["context"]
        prompt = f"Context:\n{context}\n\nQuestion: {question}\n\nAnswer:"
    try:
        return result(with_retries(lambda: client.complete(system, prompt, temperature), config.max_retries, config.retry_base, config.retry_cap))
    except Upstream as e:
        return result(NO_GENERATION, str(e))
