"""Tools over a corpus, and the loop in which a chat provider calls them.

This part runs on the driver: each tool is one query of at most ``k`` rows, whose
result becomes numbered text. Numbers run on over all tools of an answer, so that a
marker means the same everywhere; rows are kept for the bibliography.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from folioloom.functions.text import TYPE_LABELS
from folioloom.operators import citations as ct
from folioloom.operators import retrieval as rt
from folioloom.sources.providers import ChatProvider, EmbedProvider

ROUNDS = 4
LEAST_OUTPUT = 256
MARGIN = 64
HISTORY = 4


@dataclass
class Corpus:
    """What the tools search: chunks (with vectors), documents, figures, and a provider for the query's vector."""

    chunks: DataFrame
    docs: DataFrame
    figures: DataFrame
    embed: EmbedProvider
    k: int = 10
    per_doc: int = 5
    index_file: str = "index.pdf"

    def vector(self, query: str) -> list[float]:
        return self.embed.embed([query])[0]


def arguments(raw: str | dict) -> dict[str, Any]:
    """A call's arguments from JSON, with or without a code fence or words around it."""
    if isinstance(raw, dict):
        return raw
    body = re.sub(r"^```(?:json)?\s*|\s*```$", "", raw.strip())
    try:
        return json.loads(body)
    except json.JSONDecodeError:
        inner = re.search(r"\{.*\}", body, re.S)
        if inner is None:
            raise
        return json.loads(inner.group())


def _found(corpus: Corpus, query: str, filters: rt.Filters) -> list[Row]:
    rows = rt.retrieve(corpus.chunks, corpus.docs, query, corpus.vector(query), corpus.k, filters, corpus.per_doc)
    return rows.withColumn("source_line", rt.source_line()).limit(corpus.k).collect()


def _filters(args: dict, *names: str) -> rt.Filters:
    return rt.Filters(**{n: args[n] for n in names if args.get(n) is not None})


def search_documents(corpus: Corpus, args: dict, start: int) -> tuple[str, list[Row]]:
    rows = _found(corpus, args["query"], _filters(args, "document_type", "year_from", "year_to", "language", "publication"))
    if not rows:
        return "(No relevant passages found.)", []
    df = corpus.docs.sparkSession.createDataFrame(rows, rt.retrieve(corpus.chunks.limit(0), corpus.docs, "", [0.0], 1).withColumn("source_line", F.lit("")).schema)
    blocks = ct.context_blocks(df, corpus.figures if "caption" in corpus.figures.columns else None, start).orderBy("position").collect()
    by_id = {r["chunk_id"]: r for r in rows}
    return "\n\n".join(b["block"] for b in blocks), [by_id[b["chunk_id"]] for b in blocks]


def keyword_search(corpus: Corpus, args: dict, start: int) -> tuple[str, list[Row]]:
    rows = _found(corpus, args["keyword"], _filters(args, "document_type", "year_from", "year_to"))
    if not rows:
        return f"Nothing matches the keyword {args['keyword']!r}.", []
    return "\n".join(f"[{i}] {r['source_line']}\n{r['text']}\n---" for i, r in enumerate(rows, start)), rows


def index_search(corpus: Corpus, args: dict, start: int) -> tuple[str, list[Row]]:
    query = " ".join(rt.author_parts(args["query"])) or args["query"]
    rows = _found(corpus, query, rt.Filters(source_filename=corpus.index_file))
    return ("\n".join(f"[{i}] {r['text']}\n---" for i, r in enumerate(rows, start)) or "No index entries found."), rows


def find_images(corpus: Corpus, args: dict, start: int) -> tuple[str, list[Row]]:
    """Figures aren't cited by number: their lines have none."""
    found = rt.retrieve_figures(corpus.figures, corpus.docs, args["query"], corpus.vector(args["query"]), filters=_filters(args, "year_from", "year_to"))
    rows = found.join(corpus.docs.select("doc_id", "source_filename"), "doc_id").collect()
    return ("\n".join(f"- FIGURE: {r['caption']} (Source: {r['source_filename']}, Page {r['page_num']})" for r in rows) or "No relevant images found."), []


def browse_corpus(corpus: Corpus, args: dict, start: int) -> tuple[str, list[Row]]:
    """``action``: list (default), count (of all), or group_by a field."""
    year = args.get("year")
    docs = rt.Filters(publication=args.get("publication"), author=args.get("author"), year_from=year, year_to=year).apply(corpus.docs)
    if args.get("action") == "count":
        return str(rt.overview(docs).first().asDict()), []
    if args.get("action") == "group_by":
        return "\n".join(f"{r['value']}: {r['n']}" for r in rt.count_by(docs, args.get("field", "publication")).orderBy("value").limit(100).collect()), []
    rows = rt.browse(docs).collect()
    lines = [f"{i}. {r['title']} by {r['author']} ({r['year']}) [{TYPE_LABELS.get(r['document_type'], r['document_type'])}]" for i, r in enumerate(rows, 1)]
    return "\n".join(lines) or "No documents match those filters.", []


def document_context(corpus: Corpus, args: dict, start: int) -> tuple[str, list[Row]]:
    near = rt.document_context(corpus.chunks.drop("embedding"), args["doc_id"], args["page_num"], args.get("page_window", 1))
    rows = near.join(corpus.docs, "doc_id").orderBy("start_page", "chunk_id").collect()
    return ("\n\n".join(f"[{i}] (Page {r['start_page']}):\n{r['text']}\n---" for i, r in enumerate(rows, start)) or "No further context there."), rows


#: Tools by the names that models know (fixed values), with their required arguments.
TOOLS = {
    "search_documents": (search_documents, ("query",)),
    "search_by_attribute": (search_documents, ("query",)),
    "find_images": (find_images, ("query",)),
    "browse_corpus": (browse_corpus, ()),
    "keyword_search": (keyword_search, ("keyword",)),
    "document_context": (document_context, ("doc_id", "page_num")),
    "mbras_index": (index_search, ("query",)),
}


def definitions() -> list[dict]:
    """The tools as a chat provider takes them."""
    kinds = {"page_num": "integer"}
    return [{"type": "function", "function": {"name": n, "parameters": {"type": "object", "properties": {a: {"type": kinds.get(a, "string")} for a in need}, "required": list(need)}}} for n, (_, need) in TOOLS.items()]


def call(corpus: Corpus, name: str, raw: str | dict, start: int = 1) -> tuple[str, list[Row]]:
    if name not in TOOLS:
        raise ValueError(f"Unknown tool: {name}")
    return TOOLS[name][0](corpus, arguments(raw), start)


@dataclass
class Answer:
    text: str
    sources: list[Row] = field(default_factory=list)
    rounds: int = 0


def _drop_oldest_round(messages: list[dict]) -> bool:
    for i, m in enumerate(messages):
        if m.get("tool_calls"):
            end = next((j for j in range(i + 1, len(messages)) if messages[j]["role"] != "tool"), len(messages))
            del messages[i:end]
            return True
    return False


def answer(corpus: Corpus, chat: ChatProvider, question: str, history: list[dict] | None = None, window: int = 8192, rounds: int = ROUNDS) -> Answer:
    """Retrieves, lets the provider call tools for some rounds while the window has room, and returns its text and sources."""
    context, sources = search_documents(corpus, {"query": question}, 1)
    blocks = context.split("\n\n[") if sources else [context]
    past = []
    for m in (history or [])[-HISTORY:]:
        text = m.get("content") or ""
        if m["role"] == "assistant":
            text = re.sub(ct.MARKER, "", re.split("Sources:|References:", text)[0].strip())
        past.append({"role": m["role"], "content": text})
    tools = definitions()

    def messages_with(n: int) -> list[dict]:
        return [{"role": "system", "content": "\n\n[".join(blocks[:n])}, *past, {"role": "user", "content": question}]

    n = len(blocks)
    while n > 1 and chat.count_tokens(messages_with(n), tools) > window - LEAST_OUTPUT - MARGIN:
        n -= 1  # the last block has the least score
    messages, sources, used = messages_with(n), sources[:n] if sources else [], 0
    for _ in range(rounds):
        room = window - chat.count_tokens(messages, tools) - MARGIN
        if room < LEAST_OUTPUT:
            break
        reply = chat.complete(messages, max_tokens=room, tools=tools)
        if not reply.get("tool_calls"):
            return Answer(reply.get("content") or "", sources, used)
        used += 1
        messages.append({"role": "assistant", "content": reply.get("content") or "", "tool_calls": reply["tool_calls"]})
        for t in reply["tool_calls"]:
            text, rows = call(corpus, t["function"]["name"], t["function"]["arguments"], len(sources) + 1)
            sources += rows
            messages.append({"role": "tool", "tool_call_id": t["id"], "content": text})
    while chat.count_tokens(messages) + LEAST_OUTPUT > window and _drop_oldest_round(messages):
        pass
    reply = chat.complete(messages, max_tokens=max(LEAST_OUTPUT, window - chat.count_tokens(messages) - MARGIN))
    return Answer(reply.get("content") or "", sources, used)
