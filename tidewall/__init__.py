"""Asset-condition features, evaluation and exploratory statistics as Spark DataFrame operators."""
