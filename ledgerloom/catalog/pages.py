"""Document pages derived from the given documents.

Twelve consecutive documents are the pages of one filing.  Lines a filing would
have (running head, item heading, note, table, artefacts, page number) are added by
rule, because the prose has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerloom.tables import table

PAGES_SQL = r"""pg AS (SELECT 'F' || CAST(doc_id // 12 AS VARCHAR) AS document_id, CAST(doc_id % 12 + 1 AS INTEGER) AS page,
 'LEDGER HOLDINGS, ANNUAL REPORT ' || CAST(2015 + (doc_id // 12) % 9 AS VARCHAR) || chr(10)
 || CASE WHEN doc_id % 4 = 1 THEN chr(10) || 'ITEM ' || CAST(doc_id % 12 AS VARCHAR) || '. Risk Factors' || chr(10) ELSE '' END
 || CASE WHEN doc_id % 6 = 2 THEN 'Note ' || CAST(doc_id % 12 AS VARCHAR) || ' Accounting policies' || chr(10) ELSE '' END
 || CASE WHEN doc_id % 7 = 0 THEN '0000320193' || chr(10) || 'aapl-20250927' || chr(10) || 'true' || chr(10) ELSE '' END
 || text || chr(10)
 || CASE WHEN doc_id % 5 = 3 THEN '| size | ' || CAST(n_chars AS VARCHAR) || ' | 1,200.50 |' || chr(10) || 'total' || chr(9) || '  $ 10 20 30 40' || chr(10) ELSE '' END
 || CASE WHEN doc_id % 3 = 0 THEN 'revenue rose in the year because demand was broad and' || chr(10) || 'the order book grew, while oper-' || chr(10) || 'ating costs fell' || chr(10) ELSE '' END
 || CASE WHEN doc_id % 8 = 5 THEN chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || 'xiv' || chr(10) ELSE '' END
 || 'Confidential - page ' || CAST(doc_id % 12 + 1 AS VARCHAR) || chr(10) || '- ' || CAST(doc_id % 12 + 1 AS VARCHAR) || ' -' AS text
 FROM documents)"""


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "concat('F', doc_id div 12) AS document_id", "cast(doc_id % 12 + 1 AS int) AS page",
        r"""concat('LEDGER HOLDINGS, ANNUAL REPORT ', 2015 + (doc_id div 12) % 9, '\n',
          if(doc_id % 4 = 1, concat('\nITEM ', doc_id % 12, '. Risk Factors\n'), ''),
          if(doc_id % 6 = 2, concat('Note ', doc_id % 12, ' Accounting policies\n'), ''),
          if(doc_id % 7 = 0, '0000320193\naapl-20250927\ntrue\n', ''),
          text, '\n',
          if(doc_id % 5 = 3, concat('| size | ', n_chars, ' | 1,200.50 |\ntotal\t  $ 10 20 30 40\n'), ''),
          if(doc_id % 3 = 0, 'revenue rose in the year because demand was broad and\nthe order book grew, while oper-\nating costs fell\n', ''),
          if(doc_id % 8 = 5, '\n\n\n\n\nxiv\n', ''),
          'Confidential - page ', doc_id % 12 + 1, '\n- ', doc_id % 12 + 1, ' -') AS text""")
