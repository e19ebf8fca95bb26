"""Column types of the document store and of the records around it."""

from pyspark.sql.types import (
    ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


CATALOG = _struct(
    id=LongType(), created_at=TimestampType(), document_source=StringType(), document_type=StringType(), document_name=StringType(),
    document_description=StringType(), document_usage=StringType(), date_created=TimestampType(), date_last_modified=TimestampType(),
    file_name=StringType(), file_type=StringType(), file_size=LongType(), file_path=StringType(), file_link=StringType(),
)
SECTION = _struct(
    id=LongType(), created_at=TimestampType(), document_source=StringType(), document_type=StringType(), document_name=StringType(),
    section_id=IntegerType(), section_name=StringType(), section_summary=StringType(), section_content=StringType(),
)
CATALOG_ITEM = _struct(id=StringType(), document_name=StringType(), document_description=StringType())
DOCUMENT = _struct(document_name=StringType(), sections=ArrayType(_struct(section_id=IntegerType(), section_name=StringType(), section_content=StringType())))
SECTION_CHOICE = MapType(StringType(), ArrayType(StringType()))
MESSAGE = _struct(conv_id=LongType(), turn=LongType(), role=StringType(), content=StringType())
CLARIFICATION = _struct(action=StringType(), output=StringType(), scope=StringType(), is_continuation=BooleanType())
RESEARCH = _struct(detailed_research=StringType(), status_summary=StringType())
USAGE = _struct(
    call_id=LongType(), stage=StringType(), source=StringType(), prompt_tokens=LongType(), completion_tokens=LongType(),
    prompt_cost=DoubleType(), completion_cost=DoubleType(), ok=BooleanType(),
)
STAGE = _struct(stage=StringType(), start_ts=TimestampType(), end_ts=TimestampType(), status=StringType(), details=MapType(StringType(), StringType()))
RESULT = _struct(source=StringType(), pos=LongType(), document_name=StringType(), document_description=StringType(), error=StringType(), ok=BooleanType())
SOURCE = _struct(key=StringType(), source_value=StringType(), display_name=StringType(), description=StringType(), query_type=StringType(), content_type=StringType(), use_when=StringType(), implemented=BooleanType(), two_phase=BooleanType())
