"""The tables the operators work on, as DDL for readers. Columns added later are nullable, so old rows stay readable."""

from __future__ import annotations

BLOCK = "struct<text:string,page_number:int,heading_level:int>"

# Uploaded files after parsing; status is UPLOADED, PROCESSING, READY or FAILED.
DOCUMENTS = f"""
    document_id string, filename string, file_type string, storage_path string, size_bytes bigint,
    sha256 string, content_sha256 string, content string, blocks array<{BLOCK}>, status string,
    created_at timestamp, summary string, error_message string, attempts int, last_attempt_at timestamp,
    failure_kind string
"""

BLOCKS = "document_id string, pos int, text string, page_number int, heading_level int"

SECTIONS = """
    document_id string, section_no bigint, section_id string, title string, level int,
    parent_section_id string, path array<string>
"""

CHUNKS = """
    document_id string, filename string, chunk_index int, chunk_id string, section_id string,
    section_title string, section_path string, section_level int, parent_section_id string,
    page_number int, content string, embedding array<float>
"""

# A distance where lower is better, or a keyword score where higher is: see the source.
HITS = """
    question_id string, number int, chunk_id string, document_id string, filename string, content string,
    url string, section_id string, section_title string, section_path string, parent_section_id string,
    page_number int, score double, uploaded_at timestamp, derived_from array<string>,
    sources array<string>, semantic_rank int, keyword_rank int, fused_score double
"""

QUESTIONS = "question_id string, question string, embedding array<float>, scope array<string>"

CHATS = "chat_id string, title string, created_at timestamp, updated_at timestamp"

# One result as it was shown; a run holds those of one question, in order.
RESULT = ("struct<number:int,chunk_id:string,document_id:string,filename:string,content:string,section_path:string,"
          "page_number:int,score:double,sources:array<string>>")

RUNS = f"""
    run_id string, chat_id string, turn_index bigint, question string, relation string,
    standalone_question string, context_strategy string, composition string, mode string, top_k int,
    answer string, answered boolean, citation_count int, chunk_count int, latency_ms double,
    retrieval_method string, created_at timestamp, results array<{RESULT}>, cited array<int>
"""

ANSWER_CACHE = """
    scope string, entry string, question string, embedding array<float>, stored_at timestamp,
    ttl_seconds int, answered boolean
"""

# What the binary file source yields.
FILES = "path string, modificationTime timestamp, length bigint, content binary"
