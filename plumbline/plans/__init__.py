"""Plan shapes the operators share: long form, order statistics, frequencies."""
