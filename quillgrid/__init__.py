"""quillgrid: everyday table work as lazy PySpark DataFrame operations."""
