"""tabsieve: data-quality checks, profiling, preparation and binary
classification expressed as Spark DataFrame / SQL / ML jobs."""

__version__ = "0.1.0"
