"""Explicit schemas of the document model.  Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

IR_VERSION = "1.0"

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


BBOX = struct(left=_D, top=_D, right=_D, bottom=_D, page_width=_D, page_height=_D)
RISK = struct(risk_type=_S, message=_S)
METADATA = struct(label=_S, self_ref=_S, caption_refs=T.ArrayType(_S), layout_adjusted=_B, section_path=T.ArrayType(_S), source_asset_path=_S, confidence=_D)
#: A block: the smallest typed unit, in reading order ``pos`` within ``doc_id``.
BLOCK = struct(doc_id=_L, pos=_I, block_id=_S, kind=_S, text=_S, markdown=_S, page_no=_I, bbox=BBOX, heading_level=_I, risks=T.ArrayType(RISK), metadata=METADATA)
#: Rows of a replay file: job, chunk and event records in one table.
REPLAY = T.StructType(
    [
        *struct(recordType=_S, jobId=_S, mode=_S, workflowVersion=_S, promptVersion=_S, status=_S, chunkIndex=_I, chunkType=_S).fields,
        T.StructField("sectionPath", T.ArrayType(_S)),
        *struct(sourceSha256=_S, translationSha256=_S, sourceChars=_I, translationChars=_I, revisionCount=_I).fields,
        T.StructField("riskTypes", T.ArrayType(_S)),
        *struct(sourceText=_S, translatedText=_S, node=_S, elapsedMs=_L).fields,
    ]
)
IR_DOCUMENT = struct(version=_S, docId=_L, sections=T.ArrayType(struct(sectionId=_S, title=_S, level=_I, path=T.ArrayType(_S))), blocks=T.ArrayType(struct(blockId=_S, kind=_S, text=_S, markdown=_S, order=_I, pageNo=_I, headingLevel=_I, sectionId=_S)))
EVENT = struct(event_seq=_L, job_id=_L, node=_S, event_type=_S, status=_S, elapsed_ms=_D, created_at=T.TimestampType())
