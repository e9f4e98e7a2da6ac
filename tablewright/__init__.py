"""Analytics over tables recovered from documents, as Spark DataFrame plans."""

from .operators.quality import document_verdict, table_quality
from .operators.route import probe_pages
from .plans.batch import convert_directory, convert_file
from .plans.convert import convert
from .sources.config import get_api_key, get_model_name

__all__ = ["convert", "convert_directory", "convert_file", "document_verdict", "get_api_key", "get_model_name", "probe_pages", "table_quality"]
