"""Explicit schemas of the persistent tables and of generator answers; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PAPERS = _struct(
    paper_hash=_S, paper_name=_S, pdf_path=_S, page_count=_I, model_used=_S, code_model_used=_S, strategy=_S,
    summary_md=_S, symbolic_logic_md=_S, cpp_examples_md=_S, extras_md=_S, diagrams_raw=_S,
    sections_completed=T.ArrayType(_S), source_corpus=_S, processed_at=_S, created_at=_S, updated_at=_S,
)
DIAGRAMS = _struct(paper_hash=_S, idx=_I, title=_S, dot_src=_S, svg_content=_S)
OCR_CACHE = _struct(paper_hash=_S, page_idx=_I, ocr_profile=_S, text=_S)
LEASES = _struct(resource_key=_S, owner_id=_S, generation=_L, renewed_at=_D, active=_B)
EVIDENCE = _struct(evidence_id=_S, chunk_index=_I, kind=_S, statement=_S, support=_S, page=_I)
RELATIONSHIP = _struct(evidence_ids=T.ArrayType(_S), description=_S)
CHUNK_EVIDENCE = _struct(chunk_index=_I, page_start=_I, page_end=_I, summary=_S, evidence=T.ArrayType(EVIDENCE), rejected_items=_I)
DOSSIER = _struct(page_start=_I, page_end=_I, summary=_S, selected_evidence_ids=T.ArrayType(_S), relationships=T.ArrayType(RELATIONSHIP))
BUNDLE = _struct(schema_version=_I, paper_hash=_S, model=_S, physical_page_count=_I, chunks=T.ArrayType(CHUNK_EVIDENCE), root=DOSSIER, reduction_levels=_I)
MAP_ANSWER = _struct(chunk_summary=_S, evidence=T.ArrayType(_struct(kind=_S, statement=_S, support=_S, page=T.VariantType())))
REDUCE_ANSWER = _struct(summary=_S, selected_evidence_ids=T.ArrayType(_S), relationships=T.ArrayType(RELATIONSHIP))
GRAPH_PAPERS = _struct(paper_hash=_S, digest=_S)
GRAPH_NODES = _struct(paper_hash=_S, id=_S, type=_S, label=_S)
GRAPH_EDGES = _struct(paper_hash=_S, src=_S, dst=_S, type=_S, description=_S)
