"""The engine: index a tree into tables, answer searches, lookups, traversals and memory calls.

Every answer is a DataFrame, but for the memory calls, which change state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import masking, paths
from ..functions import text as X
from ..operators import bm25, chunking, embedding, graph, hybrid, inference, memory, parsing, vectors
from ..sources import repo
from ..sources.store import SnapshotStore, changes

FILES = "id string, path string, absolute_path string, language string, size_bytes long, line_count int, hash string, modified_at timestamp, framework string, indexed_at timestamp"
SYMBOLS = "file_path string, parent_name string, name string, qualified_name string, symbol_type string, line_start int, line_end int, visibility string, docstring string, detail string, language string, file_id string, id string, parent_id string"
CHUNKS = "id string, file_id string, file_path string, symbol_id string, content string, content_masked string, language string, symbol_name string, symbol_type string, line_start int, line_end int, hash string, token_count int, chunk_index int"
RELATIONSHIPS = "source_symbol_id string, source_file_path string, target_symbol_id string, target_name string, relationship_type string, confidence double, origin string, seq long, id string"
VECTORS = "id string, embedding array<float>, language string, file_path string"
EDGES = "src string, dst string, type string, confidence double"
POSTINGS = "term string, id string, tf long, dl int, file_path string"
TERMS = "term string, df long, cf long, idf double"
LENGTHS = "id string, dl int, file_path string"
SNIPPET, LONG_SNIPPET = 1000, 2000


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: C.Config | None = None, embedder=None):
        self.spark, self.config = spark, config or C.Config()
        self.embedder = embedder or embedding.HashingEmbedder(self.config.embedding.dimension)
        self.store = SnapshotStore(spark, f"{root.rstrip('/')}/index")
        self.memory = memory.MemoryStore(spark, f"{root.rstrip('/')}/memory", self.config.memory.max_per_category)

    # ------------------------------------------------------------ tables

    def files(self) -> DataFrame:
        return self.store.read("files", FILES)

    def symbols(self) -> DataFrame:
        return self.store.read("symbols", SYMBOLS)

    def chunks(self) -> DataFrame:
        return self.store.read("chunks", CHUNKS)

    def relationships(self) -> DataFrame:
        return self.store.read("relationships", RELATIONSHIPS)

    def vectors(self) -> DataFrame:
        return self.store.read("vectors", VECTORS)

    def edges(self) -> DataFrame:
        return self.store.read("edges", EDGES)

    def text_index(self) -> bm25.Index:
        """The stored inverted index of the chunks."""
        n, mean_length = self.store.read("lengths", LENGTHS).agg(F.count(F.lit(1)), F.avg("dl")).first()
        return bm25.Index(self.store.read("postings", POSTINGS), self.store.read("terms", TERMS), n, mean_length or 1.0)

    # ------------------------------------------------------------ indexing

    def index(self, tree: str, full: bool = False) -> dict[str, int]:
        """Bring the tables up to date with a tree; rows of changed and vanished files are replaced in one commit."""
        c = self.config
        scanned = repo.scan(self.spark, tree, c.security.max_file_bytes, c.security.never_index).persist()
        status = changes(scanned.select("path", "hash"), self.files().select("path", "hash"), "path").persist()
        count = {r[0]: r[1] for r in status.groupBy("status").count().collect()}
        redo = status.where(F.col("status") != "deleted") if full else status.where(F.col("status").isin("new", "modified"))
        gone = status.where("status <> 'unchanged'") if not full else status
        sources = scanned.join(redo.select("path"), "path", "left_semi").persist()
        framework = paths.framework_of(scanned.select("path"))
        parsed = parsing.parse_files(sources).persist()
        symbols = parsing.symbols_of(parsed, sources).select(*[x.split(" ")[0] for x in SYMBOLS.split(", ")]).persist()
        made = chunking.chunk_files(sources, parsed, c.chunking.sizes(), c.security.enable_pii_masking).persist()
        dim = self.embedder
        vecs = embedding.embed_table(made.select("id", F.col("content_masked").alias("text")), lambda: dim, c.embedding.batch_size)
        vecs = vecs.join(made.select("id", "language", "file_path"), "id")
        new_files = sources.drop("source").withColumns({"framework": F.lit(framework).cast("string"), "indexed_at": F.current_timestamp()})
        path_gone = gone.select("path")
        file_gone = path_gone.withColumnRenamed("path", "file_path")
        all_symbols = self.store.replace_rows("symbols", SYMBOLS, file_gone, symbols, "file_path").persist()
        parsed_rel = parsing.relationships_of(parsed, symbols)
        old_rel = self.relationships().where("origin = 'parsed'").join(path_gone.select(F.col("path").alias("source_file_path")), "source_file_path", "left_anti")
        inferred = inference.infer(all_symbols, scanned.select("path", "source"))
        columns = [x.split(" ")[0] for x in RELATIONSHIPS.split(", ")]
        rel = graph.last_wins(old_rel.select(*columns).unionByName(parsed_rel.select(*columns)).unionByName(inferred.select(*columns)), "id", "seq")
        counted = made.select("id", X.tokenize(F.coalesce("content", F.lit(""))).alias("tokens"), "file_path")
        postings = self.store.replace_rows("postings", POSTINGS, file_gone, bm25.postings_of(counted).select("term", "id", "tf", "dl", "file_path"), "file_path").persist()
        lengths = self.store.replace_rows("lengths", LENGTHS, file_gone, counted.select("id", F.size("tokens").alias("dl"), "file_path"), "file_path").persist()
        self.store.commit(
            {
                "postings": bm25.by_term(postings, "id"),
                "terms": bm25.by_term(bm25.terms_of(postings, lengths.count())),
                "lengths": lengths,
                "edges": graph.edges_of(graph.resolve(rel, graph.name_index(all_symbols))),
                "files": self.store.replace_rows("files", FILES, path_gone, new_files.select(*[x.split(" ")[0] for x in FILES.split(", ")]), "path"),
                "symbols": all_symbols,
                "chunks": self.store.replace_rows("chunks", CHUNKS, file_gone, made, "file_path"),
                "relationships": rel,
                "vectors": self.store.replace_rows("vectors", VECTORS, file_gone, vecs.select("id", "embedding", "language", "file_path"), "file_path"),
            }
        )
        failed = parsed.where(F.size("errors") > 0).count()
        out = {s: count.get(s, 0) for s in ("new", "modified", "unchanged", "deleted")} | {"scanned": scanned.count(), "indexed": sources.count(), "with_errors": failed, "symbols": symbols.count(), "chunks": made.count()}
        for df in (scanned, status, sources, parsed, symbols, made, all_symbols, postings, lengths):
            df.unpersist()
        return out

    # ------------------------------------------------------------ search

    def search_codebase(self, text: str, limit: int | None = None, language: str | None = None, path_filter: str | None = None, min_score: float | None = None, include_snippets: bool = True) -> DataFrame:
        """Ranked chunks. A language filters the vector leg; a path glob filters after the limit."""
        r = self.config.retrieval
        limit = min(limit or r.default_limit, r.max_limit)
        n = hybrid.candidates(limit, r.max_limit, r.multiplier)
        chunks = self.chunks()
        known = set(paths.LANGUAGE_SUFFIXES)
        where = F.col("language") == language if language in known else None
        query = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        sem = vectors.topk(self.vectors(), embedding.embed_query(text, self.embedder), n, where).select(F.lit(0).cast("long").alias("query_id"), "id", "score")
        bm = bm25.search_index(self.text_index(), query, n)
        symbols = self.symbols().select(F.col("id").alias("symbol_id"), "name", F.col("file_path").alias("file"))
        sy = hybrid.symbol_leg(query, symbols, chunks.select("id", F.col("file_path").alias("file")))
        ranked = hybrid.fuse({"semantic": sem, "bm25": bm, "symbol": sy}, r.weights(), limit, r.min_score if min_score is None else min_score)
        snippet = X.snippet(masking.redact(F.col("content")), LONG_SNIPPET) if include_snippets else F.lit("")
        out = ranked.join(chunks, "id").select("rank", F.col("id").alias("chunk_id"), "file_path", "symbol_name", "symbol_type", "language", snippet.alias("snippet"), "line_start", "line_end", F.round("score", 4).alias("score"), F.struct("semantic", "bm25", "symbol", "graph").alias("score_breakdown"))
        return (out if path_filter is None else out.where(paths.glob_match(F.col("file_path"), path_filter))).orderBy("rank")

    def find_similar_code(self, code: str, limit: int = 5) -> DataFrame:
        return self.search_codebase(code, min(limit, 20))

    def search_symbol(self, name: str, symbol_type: str | None = None, language: str | None = None, limit: int = 20) -> DataFrame:
        found = self.symbols().where(X.like_any_case(F.col("name"), F.lit(name)))
        for column, value in (("symbol_type", symbol_type), ("language", language)):
            found = found if value is None else found.where(F.col(column) == value)
        return found.orderBy("name", "file_path", "line_start", "id").limit(limit)

    def symbols_of_file(self, path: str, limit: int = 1000) -> DataFrame:
        """Symbols of one file by line."""
        found = self.symbols().where(F.col("file_path") == path).orderBy("line_start", "id").limit(limit)
        return found.select("name", "qualified_name", "symbol_type", "line_start", "line_end", "visibility", "id")

    def relationships_of(self, node: str, kind: str | None = None) -> DataFrame:
        """Edges from or to a symbol id, of one type if given."""
        return graph.lookup(self.edges(), node, kind)

    def read_chunk(self, chunk_id: str) -> DataFrame:
        return self.chunks().where(F.col("id") == chunk_id).select("id", "file_path", "symbol_name", "line_start", "line_end", masking.redact(F.col("content")).alias("content"))

    # ------------------------------------------------------------ graph

    def _named(self, name: str, first: int = 3) -> DataFrame:
        own = self.symbols().where((F.col("name") == name) | (F.col("qualified_name") == name))
        return own.orderBy("file_path", "line_start", "id").limit(first).select(F.col("id").alias("node"))

    def _described(self, reached: DataFrame) -> DataFrame:
        own = self.symbols().select(F.col("id").alias("node"), "name", "qualified_name", "symbol_type", "file_path", "line_start")
        best = reached.groupBy("node").agg(F.min(F.struct("depth", "type", "confidence")).alias("x"))
        return best.join(own, "node").select("name", "qualified_name", "symbol_type", "file_path", "line_start", F.col("x.type").alias("relationship"), F.round("x.confidence", 2).alias("confidence"), F.col("x.depth").alias("depth"))

    def find_references(self, name: str, depth: int = 2) -> DataFrame:
        return self._described(graph.references(self.edges(), self._named(name), min(depth, graph.MAX_DEPTH)))

    def find_dependencies(self, name: str, depth: int = 2) -> DataFrame:
        return self._described(graph.dependencies(self.edges(), self._named(name), min(depth, graph.MAX_DEPTH)))

    def find_callers(self, name: str) -> DataFrame:
        return self._described(graph.callers(self.edges(), self._named(name)))

    def find_callees(self, name: str) -> DataFrame:
        return self._described(graph.callees(self.edges(), self._named(name)))

    def trace_flow(self, start: str, target: str) -> DataFrame:
        ends = [self._named(x, 1).first() for x in (start, target)]
        if None in ends:
            return self.spark.createDataFrame([], "step int, name string, file_path string, line_start int")
        path = graph.shortest_path(self.edges(), ends[0][0], ends[1][0])
        return path.join(self.symbols(), F.col("node") == F.col("id")).select("step", "name", "file_path", "line_start").orderBy("step")

    # ------------------------------------------------------------ overview

    def explain_architecture(self) -> DataFrame:
        one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
        languages = self.files().groupBy("language").count().agg(F.map_from_entries(F.collect_list(F.struct("language", "count"))).alias("languages"))
        edges = self.edges()
        sizes = graph.counts(edges, self.symbols().select(F.col("id").alias("node")))
        out = one(self.files(), "files")
        for df in (one(self.symbols(), "symbols"), one(self.chunks(), "chunks"), one(self.vectors(), "vectors"), languages, sizes):
            out = out.join(df)
        return out.withColumn("embedding_model", F.lit(self.embedder.model_name))

    get_stats = explain_architecture

    def recent_changes(self, limit: int = 20) -> DataFrame:
        rows = self.files().where("indexed_at is not null").orderBy(F.desc("indexed_at"), "path").limit(min(limit, 100))
        return rows.select("path", "language", F.date_format("indexed_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("indexed_at"))

    # ------------------------------------------------------------ memory

    def save_memory(self, content: str, category: str = "general", tags: list[str] | None = None) -> str:
        return self.memory.save(content, category, tags)

    def retrieve_memory(self, query: str, category: str | None = None, limit: int = 5) -> list[dict]:
        return self.memory.retrieve(query, category, None, limit)
