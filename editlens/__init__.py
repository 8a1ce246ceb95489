"""editlens: edit-quality analytics over a page-edit history, as Spark jobs."""
