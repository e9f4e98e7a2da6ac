"""Fixed schemas of the canonical relations. Tables have any columns; cells hold them all in one long form."""

TABLE_KEY = ["doc_id", "page_no", "table_no"]
CELLS = "doc_id string, page_no int, table_no int, row_no int, col_no int, col_name string, value string"
PAGES = "doc_id string, page_no int, text string, image_count int"
RAW_TABLES = "doc_id string, page_no int, table_no int, rows array<array<string>>"
RESPONSES = "doc_id string, page_no int, csv_text string"
FILES = "path string, length bigint, kind string"
