"""Data operations as Spark DataFrame functions: retrieval, chat logs, metrics, registries, validation, graphs, key/value history and configuration."""
