"""Spark jobs for labelled-vector datasets: build, profile, mix, score, evaluate and compare them."""
