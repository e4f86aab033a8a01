"""Forecast-evaluation analytics on Spark: bars, frames, origins, baselines and scores."""
