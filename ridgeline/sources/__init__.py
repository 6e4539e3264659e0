"""Readers, and adapters from the driver's tables to the shapes the operators take."""
