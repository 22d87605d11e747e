"""The corpus that queries run on: every document, decorated with Markdown structure by a function of its doc_id.

The statement is read by Spark SQL and by DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbq.session import prepare, table

KB_SQL = """
SELECT doc_id, lang, source, 'kb/s' || cast(doc_id % 20 as string) || '/doc_' || cast(doc_id as string) || '.md' AS uri,
  (CASE WHEN doc_id % 3 = 0 THEN '---' || chr(10) || 'title: Doc ' || cast(doc_id as string) || chr(10) || 'date: '
     || (CASE WHEN doc_id % 2 = 0 THEN '2024-' ELSE '2021-' END) || lpad(cast(1 + doc_id % 12 as string), 2, '0') || '-15' || chr(10) || '---' || chr(10) ELSE '' END)
  || '# Document ' || cast(doc_id as string) || chr(10) || chr(10) || text || chr(10) || chr(10)
  || (CASE doc_id % 6 WHEN 0 THEN '## Overview' WHEN 1 THEN '## TODO' WHEN 2 THEN '## Step 1' WHEN 3 THEN '## Ops' WHEN 4 THEN '## Configure OAuth Tokens' ELSE '# Billing Exports' END) || chr(10) || chr(10)
  || (CASE WHEN doc_id % 5 = 0 THEN 'As mentioned above, see below for the previous example.' || chr(10) || chr(10) ELSE '' END)
  || (CASE WHEN doc_id % 4 = 0 THEN 'Use FastAPI with Docker.' WHEN doc_id % 4 = 1 THEN 'Use Fast API with Docker.' ELSE 'Use plain services.' END) || chr(10) || chr(10)
  || (CASE WHEN doc_id % 11 = 0 THEN 'This requires Python 3.' || cast(9 + doc_id % 3 as string) || '.' || chr(10) || chr(10) ELSE '' END)
  || (CASE WHEN doc_id % 13 = 0 THEN 'Response caching is ' || (CASE WHEN doc_id % 2 = 0 THEN 'enabled' ELSE 'disabled' END) || ' by default.' || chr(10) || chr(10) ELSE '' END)
  || (CASE WHEN doc_id % 17 = 0 THEN 'The legacy token endpoint is deprecated.' || chr(10) || chr(10) WHEN doc_id % 17 = 1 THEN 'Best practice: the legacy token endpoint.' || chr(10) || chr(10) ELSE '' END)
  || (CASE WHEN doc_id % 8 = 0 THEN 'Tutorial: how to start.' || chr(10) || '1. Install' || chr(10) || '2. Verify' || chr(10) || chr(10) ELSE '' END)
  || (CASE WHEN doc_id % 6 = 0 THEN '```sql' || chr(10) || 'select 1' || chr(10) || '```' || chr(10) || chr(10) ELSE '' END)
  || '[next](doc_' || cast(doc_id + 20 as string) || '.md) [side](../s' || cast((doc_id + 1) % 20 as string) || '/doc_' || cast(doc_id + 1 as string) || '.md#top)'
  || (CASE WHEN doc_id % 7 = 0 THEN ' [gone](missing_' || cast(doc_id as string) || '.md)' ELSE '' END)
  || (CASE WHEN doc_id % 9 = 0 THEN ' [docs](https://docker.com/get)' ELSE '' END) || chr(10) AS text
FROM {documents}
"""


def kb_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, uri, text)."""
    return prepare(spark).sql(KB_SQL, documents=table(spark, sf_dir, "documents"))
