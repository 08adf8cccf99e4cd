"""Spark jobs that build, check and score stereo-vision datasets as tables of image lines."""
