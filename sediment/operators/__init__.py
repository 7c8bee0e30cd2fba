"""sediment.operators"""
