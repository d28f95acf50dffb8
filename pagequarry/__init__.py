"""Turn large tables of captured web pages into clean, typed tables with Spark."""
