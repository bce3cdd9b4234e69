"""Fixed values that must equal the reference's behaviour for equal results.

Fixed values (reference semantics, stated together in natural order):

* BM25 parameters: k1 = 1.2, b = 0.75 (Lucene's BM25Similarity defaults).
* Token pattern of the analyser: runs of letters, digits and underscore,
  lower-cased, no stop words, no stemming.
* Default result limit of the search endpoint: 20.
* Default limit of the retriever chain: 100 (class value 200).
* Default index and language of the retriever: ``demo-graz``, ``en``.
* Re-ranking keys: ``asc`` and ``desc`` (case-insensitive).
* Candidates considered in URL mode by the reference: the first 4 records.
* Chunker: separator newline, chunk size 1000, overlap 200 characters.
* Conversation memory: the last 5 exchanges.
* Sources shown with an answer: the first 3.
* Prefix of an image message: ``data:image/jpeg;base64,``.
* Prefix of a caption query: ``tell me about ``.
* Date format of schema-A ``warc_date``: ``yyyy-MM-dd'T'HH:mm:ss'Z'``.
* Fuzzy term: at most 2 edits, at most 50 expansions.
* Error texts: ``The index could not be found`` (404),
  ``The limit must be a positive value`` (400).
"""

K1 = 1.2
B = 0.75

TOKEN_PATTERN = r"[\p{L}\p{N}_]+"

DEFAULT_LIMIT = 20
RETRIEVER_LIMIT = 100
RETRIEVER_CLASS_LIMIT = 200
RETRIEVER_INDEX = "demo-graz"
RETRIEVER_LANG = "en"

RANKING_ASC = "asc"
RANKING_DESC = "desc"

URL_MODE_CANDIDATES = 4

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200

MEMORY_EXCHANGES = 5
SOURCES_SHOWN = 3

IMAGE_PREFIX = "data:image/jpeg;base64,"
CAPTION_PREFIX = "tell me about "

WARC_DATE_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

FUZZY_MAX_EDITS = 2
FUZZY_MAX_EXPANSIONS = 50

ERR_NO_INDEX = "The index could not be found"
ERR_BAD_LIMIT = "The limit must be a positive value"
# Ours: the reference answers these with a bare 500.
ERR_NO_QUERY = "The query could not be parsed"
ERR_NO_LIMIT = "The limit must be an integer"

# Sizing knobs (not reference values).
# Query-side rows up to which the query terms are broadcast to the postings scan.
BROADCAST_MAX_ROWS = 1_000_000
# Salt fan-out for the shuffle join of query terms and postings when the
# query side is too large to broadcast; splits every hot term into this many
# tasks.
TERM_SALTS = 32
# Documents of an index to one of the largest limit from where the top-k goes by
# bounds: below, the candidates are a large part of the index.
PRUNE_RATIO = 20_000
# Compressed corpus bytes whose postings make one document shard: a task sorts
# a shard's postings when it is stored, and holds the scores of its documents.
SHARD_BYTES = 4 << 20
# Document shards of an index at most (Spark's bound on buckets); beyond it
# shards grow instead.
MAX_SHARDS = 100_000
# Requests, and result rows (requests x largest limit), from where plain requests
# are answered block by block (operators.blocks).
BLOCK_MIN_REQUESTS = 1_000
BLOCK_MIN_ROWS = 200_000
# Rows that the requests of a block keep at most; postings of the documents they
# meet at once.
BLOCK_ROWS = 8_000_000
GROUP_POSTINGS = 4_000_000
# Bytes of text up to which a small table's texts are broadcast.
BROADCAST_MAX_BYTES = 64 << 20
# Result rows that a task lists at once where they are many.
TASK_ROWS = 250_000
