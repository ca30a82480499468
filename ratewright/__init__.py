"""ratewright: measurement, scoring, agreement and data-preparation operators on Spark."""
