"""Sampled-signal, spike, image and document analytics as Spark DataFrame operators."""
