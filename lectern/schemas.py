"""Row types of the tables that operators exchange."""

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType


def _row(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


POSITION = _row(pdf=IntegerType(), printed=IntegerType())
PAGE = _row(doc_id=LongType(), pdf=IntegerType(), printed=IntegerType(), text=StringType())
CHUNK = _row(
    chunk_id=StringType(), method=StringType(), rfc=IntegerType(), title=StringType(), text=StringType(), n_chars=IntegerType(),
    section_id=StringType(), section_path=StringType(), page_start=POSITION, page_end=POSITION,
)
VECTOR_ROW = _row(
    chunk_id=StringType(), method=StringType(), rfc=LongType(), title=StringType(), section_id=StringType(), section_path=StringType(),
    page_start_printed=LongType(), page_end_printed=LongType(), text=StringType(), vector=ArrayType(FloatType()),
)
#: Longest strings that the vector collection accepts, by column.
VECTOR_LIMITS = {"chunk_id": 128, "method": 32, "title": 512, "section_id": 64, "section_path": 1024, "text": 8192}
QUESTION = _row(id=StringType(), question=StringType(), answer=StringType(), evidence=StringType(), page=IntegerType(), rfc=IntegerType(), section=StringType(), answerable=BooleanType())
RECORD = _row(
    config=StringType(), qid=StringType(), answerable=BooleanType(), model=StringType(), question=StringType(), gold=StringType(), answer=StringType(), cost_usd=DoubleType(),
    tool_calls=ArrayType(StringType()), steps=IntegerType(), chunk_ids=ArrayType(StringType()), prompt_tokens=IntegerType(), completion_tokens=IntegerType(), verdict=StringType(),
)
SPEND = _row(ts=TimestampType(), chat_id=LongType(), cost_usd=DoubleType())
CHAT_EVENT = _row(chat_id=LongType(), seq=LongType(), t=DoubleType(), op=StringType(), role=StringType(), text=StringType(), cost_usd=DoubleType(), outcome=StringType())
EMBEDDING_CACHE = _row(model=StringType(), key=StringType(), vec=ArrayType(FloatType()))
PRICES = MapType(StringType(), _row(prompt=DoubleType(), completion=DoubleType()))
