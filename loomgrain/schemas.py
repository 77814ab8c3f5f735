"""Record schemas (DDL) and the fixed values that validation depends on."""

from __future__ import annotations

# Block kinds, contract literals.
BLOCK_TYPES = "title abstract heading paragraph list table figure code formula caption unknown".split()
CONTENT_TYPES = "abstract paragraph list table figure code formula caption".split()
PROTECTED_TYPES = "table figure code formula list".split()
NORMALIZATION_STATUSES = ("provided_by_dataset", "provided_by_upstream", "simulated_governed")
GOVERNANCE_STAGE = "post_normalization_packaging"

ANCHOR = (
    "struct<dataset:string,split:string,source_doc_id:string,section_name:string,"
    "paragraph_index:int,asset_file:string,extra:map<string,string>>"
)
BLOCK = (
    f"struct<block_id:string,doc_id:string,type:string,text:string,`order`:int,level:int,title_path:array<string>,"
    f"source_anchor:{ANCHOR},parent_heading_id:string,entity_tags:array<string>,metadata:map<string,string>>"
)
QUERY = (
    "struct<query_id:string,doc_id:string,dataset:string,split:string,question:string,answer:string,answer_type:string,"
    "is_unanswerable:boolean,gold_block_ids:array<string>,gold_evidence_texts:array<string>,evidence_match_score:double,"
    "question_type:string,difficulty:string,source_question_id:string,metadata:map<string,string>>"
)
DOCUMENT = (
    "doc_id string, dataset string, split string, source_doc_id string, title string, abstract string,"
    " normalization_status string, term_policy string, governance_stage string, schema_version string,"
    f" blocks array<{BLOCK}>, queries array<{QUERY}>, source_ref map<string,string>,"
    " conversion_warnings array<string>, metadata map<string,string>, created_at string"
)
#: What the chunkers need of a block; flat, so that column pruning reaches the scan.
FLAT_BLOCK = (
    "struct<block_id:string,type:string,text:string,`order`:int,title_path:array<string>,section_name:string,"
    "asset_file:string,entity_tags:array<string>>"
)
CHUNK_ANCHOR = (
    "struct<dataset:string,split:string,source_doc_id:string,sections:array<string>,first_block_id:string,"
    "last_block_id:string,block_count:int,assets:array<string>>"
)
