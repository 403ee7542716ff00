"""quire: page-graph and page-view analytics expressed as Spark DataFrame programs."""
