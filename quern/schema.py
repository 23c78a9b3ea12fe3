"""Records of the knowledge store as Spark types."""

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
STRINGS = T.ArrayType(S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RELATION = _struct(type=S, target=S, reason=S)
CONCEPT = _struct(
    id=S, name=S, aliases=STRINGS, type=S, tags=STRINGS, relations=T.ArrayType(RELATION), summary=S, mechanisms=STRINGS,
    tradeoffs=_struct(pros=STRINGS, cons=STRINGS), formulas_or_code=STRINGS, sources=STRINGS, workspace=S, created_at=S, updated_at=S,
)
WORKSPACE = _struct(id=S, name=S, description=S, tags=STRINGS, vector=T.ArrayType(D), created_at=S, updated_at=S)
EDGE = _struct(source_id=S, relation_type=S, target_id=S, reason=S, origin=S, seq=L)
SOURCE = _struct(concept_id=S, source_uri=S, workspace_id=S)
RAW_DOCUMENT = _struct(id=S, title=S, source_uri=S, content=S, char_count=L, workspace_id=S, created_at=S)
VECTOR = _struct(concept_id=S, model_name=S, dim=I, vector=T.ArrayType(D), workspace_id=S, updated_at=S)
POSTING = _struct(id=S, field=S, term=S, positions=T.ArrayType(I))
LENGTH = _struct(id=S, length=L)
LINK = _struct(a=S, b=S, degree=I, b_degree=I, stamp=S)
BATCH = _struct(stream=S, number=L)
QUERY_LOG = _struct(id=L, timestamp=S, caller=S, action=S, query=S, details_json=S, result_count=I, workspace_id=S)
SEARCH_RESULT = _struct(concept_id=S, name=S, type=S, summary=S, tags=STRINGS, score=D, matched_by=S, workspace=S)
PAGE = _struct(title=S, text=S, source=S, source_type=S, links=T.ArrayType(_struct(url=S, text=S)))
