"""Query plans: the registered queries and the planners behind them."""
