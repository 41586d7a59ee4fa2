"""The engine's facade: an indexed corpus and the tools that answer questions about it.

Model calls are injectable functions with deterministic defaults: the planner maps routes to tools, the writer extracts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TooLong
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_lines
from ..operators import catalog, edit
from ..operators import retrieval as r
from ..operators.chunking import prose_chunks, with_keys
from ..session import stored, unstored
from . import history, questions

# Calls of one question, seconds of one, documents and letters in a prompt for suggestions, letters of an answer in one for follow-ups.
MOST_CALLS, CALL_SECONDS, SUGGESTED, PREVIEW, ANSWER = 4, 30.0, 15, 80, 600
GREETING = "Hello! Ask me anything about your documents."
GENERAL = "I can list your documents, search them and summarise what they say."
SYSTEM = "Answer from the documents given, and name them."


@dataclass
class Result:
    message: str
    query_type: str
    sources: list = field(default_factory=list)
    retrieval_count: int = 0
    messages: list = field(default_factory=list)


def extract(question: str, context: str) -> str:
    """Default writer: the beginning of the context."""
    return context[:400] or "Nothing relevant was found."


def no_changes(instruction: str, content: str) -> list[dict]:
    """Default editor: proposes nothing."""
    return []


class Corpus:
    """documents (id, file_path, text and catalog columns), their chunks, keyword index and vectors, all as DataFrames.

    Postings, and from the first search on vectors, are stored for further questions until `close`; those of a workspace (keywords: KeywordIndex, vectors: VectorIndex) are its own. writer: (question, context) -> answer; model: messages -> text, used instead where
    there is one; editor: (instruction, content) -> changes. summarise makes a column of summaries out of one of transcripts; with summaries they are kept and not made twice.
    """

    def __init__(
        self, documents: DataFrame, chunks: DataFrame | None = None, embed: Callable[[DataFrame], DataFrame] = r.hashed_vectors, writer: Callable[[str, str], str] = extract, taxonomy: tuple[str, ...] = (),
        provider: str = "groq", model: Callable[[list[dict]], str] | None = None, editor: Callable[[str, str], list[dict]] = no_changes, compress: bool = False, keyword_index: bool = True,
        keywords=None, vectors=None, summarise: Callable[[Column], Column] = history.last_line, summaries: history.Summaries | None = None,
    ):
        self.documents = documents
        self.chunks = chunks if chunks is not None else with_keys(prose_chunks(documents))
        self.embed, self.writer, self.taxonomy = embed, writer, taxonomy
        self.provider, self.model, self.editor, self.compress = provider, model, editor, compress
        self.keywords = keywords if keywords is not None else r.Bm25Index(self.chunks, keep=True) if keyword_index else None
        self._vectors, self.owned = vectors, [t for t, given in (("keywords", keywords), ("vectors", vectors)) if given is None]
        self.summarise, self.summaries = summarise, summaries
        self.proposals: list[DataFrame] = []

    def close(self) -> None:
        if "keywords" in self.owned and self.keywords is not None:
            self.keywords.close()
        if "vectors" in self.owned and self._vectors is not None:
            unstored(self._vectors)
            self._vectors = None

    @property
    def vectors(self):
        """The vectors of the chunks; unless they are given, they are made for the first question that searches."""
        if self._vectors is None:
            self._vectors = stored(self.embed(self.chunks), "vectors")
        return self._vectors

    def policy(self, filename: str | None, aggregation: bool) -> r.Policy:
        return r.POLICIES["aggregation" if aggregation else "file" if filename else "search"]

    def candidates(self, question: str, k: int) -> tuple[DataFrame, DataFrame | None]:
        """(semantic, keyword) hits."""
        spark = self.documents.sparkSession
        query = self.embed(spark.createDataFrame([("q", question)], "chunk_key string, text string")).first()["embedding"]
        near = r.cosine_topk(self.vectors, query, k) if isinstance(self.vectors, DataFrame) else self.vectors.search(query, k)
        return near, None if self.keywords is None else self.keywords.search(question, k)

    def rows(self, question: str, filename: str | None = None, aggregation: bool = False) -> DataFrame:
        """The chunks that a question is answered from. They are at most two top ks and go to the driver once: whatever is asked of them does not search again."""
        policy = self.policy(filename, aggregation)
        found = r.hybrid(self.chunks, *self.candidates(question, policy.top_k), policy, filename)
        return self.documents.sparkSession.createDataFrame(found.collect(), found.schema)

    def inspect(self, question: str, filename: str | None = None) -> dict[str, DataFrame]:
        """The intermediate results of a search, to be looked at."""
        policy = self.policy(filename, False)
        semantic, keyword = self.candidates(question, policy.top_k)
        rows = r.hybrid(self.chunks, semantic, keyword, policy, filename)
        blocks = r.context_blocks(rows, policy.per_document)
        steps = {"semantic": semantic, "rows": rows, "blocks": blocks, "sources": r.sources(blocks, policy)}
        return steps if keyword is None else steps | {"keyword": keyword, "fused": r.fuse(semantic, keyword)}

    def search(self, question: str, filename: str | None = None, aggregation: bool = False, selected: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
        """(context blocks, sources) of a question: the whole file if the hits point at one, selected files alone if any are, long contexts compressed if that is on."""
        policy = self.policy(filename, aggregation)
        rows = self.rows(question, filename, aggregation)
        if self.compress:
            rows = r.compressed(rows, filename=filename, aggregation=aggregation)
        blocks = r.answer_blocks(rows, self.chunks, policy, bool(filename), aggregation, selected)
        return blocks, r.sources(blocks, policy)

    def context(self, blocks: DataFrame) -> str:
        """The blocks as one text that the provider takes: whole ones while they fit."""
        named = blocks.select(F.lit(1).alias("id"), "pos", F.concat(F.lit("[Document: "), F.regexp_extract("file_path", r"([^/]*)$", 1), F.lit("]\n"), "block").alias("block"))
        fits = r.truncate_context(named, history.limit(self.provider, "context"), len(r.SEPARATOR), r.SEPARATOR).first()  # one row, bounded by the provider's limit
        return fits["context"] if fits else ""

    def list_documents(self) -> DataFrame:
        return catalog.listing(self.documents)

    def summarize(self) -> DataFrame:
        return catalog.summary(self.documents)

    def files_of(self, question: str) -> DataFrame:
        """Paths of the files that a question names; none if it names none."""
        name = self.documents.sparkSession.range(1).select(questions.explicit_file(F.lit(question)).alias("f")).first()["f"]
        return r.files_named(self.chunks, name)

    def listing(self, types: list[str] | None) -> Result:
        """A listing answer: a category's documents, a word that there are none, or all documents; previews share the provider's budget."""
        kind = catalog.category_answer(self.documents, types).first() if types else None
        label = " or ".join(t.lower() for t in types or ())
        if kind is not None and kind["kind"] == "none":
            return Result(f"No document is indexed as {label}.", "document_listing")
        wanted = types if kind is not None and kind["kind"] == "matched" else None
        shown = catalog.listed_rows(self.documents, history.listing_budget(self.provider, self.documents.count()), wanted)
        rows = [x.asDict() for x in shown.limit(r.POLICIES["listing"].sources).collect()]
        head = f"{kind['documents']} document(s) indexed as {label}:" if wanted else self.summarize().first()["summary"]
        return Result(head + "".join(f"\n- {x['filename']}" for x in rows), "document_listing", rows, len(rows))

    def said(self, pairs: DataFrame | None, session: int | None, question: str) -> list[dict]:
        """The messages of a model call: system, what was said in the session (older pairs summarised) and the question."""
        if pairs is None:
            return [{"role": "system", "content": SYSTEM}, {"role": "user", "content": question}]
        rows = history.history(pairs.filter(F.col("session_id") == session), summarise=self.summarise, cache=self.summaries)
        found = history.messages(SYSTEM, rows, question).first()  # a dozen messages
        return [m.asDict() for m in found["messages"]] if found else self.said(None, None, question)

    def reply(self, question: str, prompt: str, context: str, pairs: DataFrame | None, session: int | None) -> tuple[str, list[dict]]:
        messages = self.said(pairs, session, prompt)
        return (self.model(messages) if self.model else self.writer(question, context)), messages

    def ask(self, question: str, last_file: str | None = None, pairs: DataFrame | None = None, session: int | None = None, selected: tuple[str, ...] = ()) -> Result:
        """Rewrites, routes and answers one question; at most some dozen rows reach the driver.

        pairs: (session_id, position, user_message, ai_response) said before; selected: parts of the paths of files to answer from.
        """
        spark = self.documents.sparkSession
        q = spark.createDataFrame([(question, last_file)], "q string, f string")
        asked = q.select(questions.rewritten(F.col("q"), F.col("f")).alias("q")).select("q", questions.route(F.col("q")).alias("route"), questions.explicit_file(F.col("q")).alias("file"), questions.is_aggregation(F.col("q")).alias("aggregation"), (questions.categories(F.col("q"), list(self.taxonomy)) if self.taxonomy else F.lit(None).cast("array<string>")).alias("categories")).first()
        if asked["route"] in ("greeting", "general"):
            return Result(GREETING if asked["route"] == "greeting" else GENERAL, asked["route"])
        if asked["route"] == "document_listing":
            return self.listing(asked["categories"])
        blocks, sources = self.search(asked["q"], asked["file"], asked["aggregation"], selected)
        context = self.context(blocks)
        prompt = f"{context}\n\nQuestion: {asked['q']}"
        if len(prompt) > (most := history.limit(self.provider, "prompt")):
            prompt = f"{context[: max(0, most - len(asked['q']) - 40)].rstrip()}\n\n[Truncated.]\n\nQuestion: {asked['q']}"
        message, messages = self.reply(asked["q"], prompt, context, pairs, session)
        found = [x.asDict() for x in sources.collect()]
        return Result(message, "document_search", found, sum(x["chunks_found"] for x in found), messages)

    def ask_stream(self, question: str, last_file: str | None = None, **more) -> Iterator[tuple[str, object]]:
        """meta, proposals, tokens and done as events."""
        try:
            answer = self.ask(question, last_file, **more)
        except Exception as e:  # the consumer of the stream gets the failure as an event
            yield "error", str(e)
            return
        yield "meta", {"query_type": answer.query_type, "sources": answer.sources}
        if self.proposals:
            yield "proposals", [p.asDict() for p in edit.shown_proposals(self.proposals[-1]).collect()]
        for word in answer.message.split(" "):
            yield "token", word + " "
        yield "done", answer

    def propose_edit(self, name: str, instruction: str, as_of: str) -> DataFrame:
        """Proposals to change a document by its name, as a client sees them; they are kept to be applied."""
        doc = self.documents.filter(F.lower(F.regexp_extract("file_path", r"([^/]*)$", 1)) == name.lower()).orderBy("file_path").select("id", "file_path", F.col("text").alias("content")).limit(1)
        row = doc.first()
        changes = self.editor(instruction, (row["content"] or "")[: edit.SNAPSHOT]) if row else []
        kind = "array<struct<find:string,replace:string>>"
        rows = self.documents.sparkSession.createDataFrame([(row["id"], row["file_path"], row["content"], [(c.get("find"), c.get("replace")) for c in changes])] if row else [], f"id long, file_path string, content string, changes {kind}")
        self.proposals.append(edit.proposals(rows, as_of))
        return edit.shown_proposals(self.proposals[-1])

    def apply_edits(self, as_of: str) -> DataFrame:
        """Applies the proposals that are still alive, once: id, file_path, text, applied, outcome."""
        out = edit.applied_proposals(self.proposals.pop(), self.documents.select("id", F.col("text").alias("content")), as_of)
        return out

    def run_tools(self, calls: list[tuple[str, dict]], seconds: float = CALL_SECONDS) -> list[tuple[str, DataFrame | str]]:
        """Results of at most MOST_CALLS tool calls (name, arguments), one after the other.

        A result is complete when it is returned, a stored table of any size. Unknown tools, wrong arguments, failures and calls that take longer become error texts.
        """
        tools = {
            "list_documents": self.list_documents, "search_documents": lambda **a: self.search(**a)[0], "search_specific_document": lambda name: self.search(name, name)[0], "summarize_corpus": self.summarize,
            "propose_edit": self.propose_edit,
        }
        out: list[tuple[str, DataFrame | str]] = []
        spark = self.documents.sparkSession

        def one(name: str, arguments: dict, group: str) -> DataFrame:
            spark.sparkContext.setJobGroup(group, f"tool {name}", interruptOnCancel=True)
            return stored(tools[name](**arguments), "tool")

        for name, arguments in calls[:MOST_CALLS]:
            group, pool = uuid.uuid4().hex, ThreadPoolExecutor(1)
            try:
                out.append((name, pool.submit(one, name, arguments, group).result(timeout=seconds)))
            except TooLong:
                spark.sparkContext.cancelJobGroup(group)
                out.append((name, f"error: took longer than {seconds:g} seconds"))
            except Exception as e:  # errors are results too
                out.append((name, f"error: {type(e).__name__}: {e}"))
            finally:
                pool.shutdown(wait=False)
        return out

    def sources_of(self, results: list[tuple[str, DataFrame | str]]) -> DataFrame:
        """Sources of several tools' results together, each file once with its best score."""
        found = [t.select("file_path", F.col("relevance_score").cast("double").alias("relevance_score")) for _, t in results if not isinstance(t, str) and {"file_path", "relevance_score"} <= set(t.columns)]
        spark = self.documents.sparkSession
        every = spark.createDataFrame([], "file_path string, relevance_score double")
        for t in found:
            every = every.unionByName(t)
        return every.groupBy("file_path").agg(F.max("relevance_score").alias("relevance_score")).orderBy(F.desc("relevance_score"), "file_path")

    def suggestions_prompt(self) -> str:
        """What a model is asked for questions about the corpus: its first documents with short previews."""
        rows = self.list_documents().orderBy("file_path").limit(SUGGESTED).collect()
        lines = [f"- {x['filename']}: {(x['preview'] or '')[:PREVIEW].strip()}" for x in rows]
        return f"Write four short questions about these {self.documents.count()} document(s), one a line:\n" + "\n".join(lines)

    def suggestions(self, model: Callable[[str], str]) -> list[str]:
        return self._lines(model(self.suggestions_prompt()), 8, 4)

    def follow_ups(self, question: str, answer: str, model: Callable[[str], str]) -> list[str]:
        return self._lines(model(f"Write three short questions that follow, one a line.\nAsked: {question}\nAnswered: {answer[:ANSWER].strip()}"), 6, 3) if question and answer else []

    def _lines(self, text: str, least: int, most: int) -> list[str]:
        return self.documents.sparkSession.createDataFrame([(text,)], "t string").select(clean_lines(F.col("t"), least, most).alias("q")).first()["q"]
