"""Multi-stage plans composed of operators."""
