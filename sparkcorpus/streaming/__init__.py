"""The data model is batch only; there is no streaming job."""
