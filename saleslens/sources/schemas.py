"""Explicit schemas of the raw tables; nothing is inferred."""

from pyspark.sql.types import BooleanType, DateType, DoubleType, IntegerType, StringType, StructField, StructType


def _schema(**columns) -> StructType:
    return StructType([StructField(k, v()) for k, v in columns.items()])


SALES = _schema(id=IntegerType, date=DateType, store_nbr=IntegerType, family=StringType, sales=DoubleType, onpromotion=IntegerType)
STORES = _schema(store_nbr=IntegerType, city=StringType, state=StringType, type=StringType, cluster=IntegerType)
OIL = _schema(date=DateType, dcoilwtico=DoubleType)
HOLIDAYS = _schema(date=DateType, type=StringType, locale=StringType, locale_name=StringType, description=StringType, transferred=BooleanType)
TRANSACTIONS = _schema(date=DateType, store_nbr=IntegerType, transactions=IntegerType)

#: Raw files: name -> whether a run needs it.
RAW_FILES = {"train.csv": True, "stores.csv": True, "oil.csv": True, "holidays_events.csv": True, "transactions.csv": False, "test.csv": False, "sample_submission.csv": False}
