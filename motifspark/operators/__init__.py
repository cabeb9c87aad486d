"""Models and operators on sequence sets."""
