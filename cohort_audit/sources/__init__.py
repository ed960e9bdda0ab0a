"""Reading, checking, describing and generating scored cohort tables."""
